"""Laid-out documents as JSON: what a converter extracts from a page, with boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<l:double,r:double,t:double,b:double,coord_origin:string>"
PROV = f"array<struct<page_no:int,bbox:{BOX}>>"
CAPTIONS = "array<struct<text:string>>"
CELLS = "struct<num_rows:int,num_cols:int,table_cells:array<struct<start_row_offset_idx:int,start_col_offset_idx:int,text:string>>>"
ITEM = f"array<struct<label:string,text:string,marker:string,content_layer:string,prov:{PROV},captions:{CAPTIONS},data:{CELLS}>>"
SCHEMA = f"texts {ITEM}, tables {ITEM}, pictures {ITEM}, pages map<string,struct<size:struct<width:double,height:double>>>"
KINDS = ("texts", "tables", "pictures")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(doc, texts, tables, pictures, pages), one row for each file; doc is the name without its ending."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select(name.alias("doc"), *KINDS, "pages")


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """As read_layout, of files that hold a document a line, as write_layouts writes them."""
    return spark.read.schema(f"doc string, {SCHEMA}").json(path).select("doc", *KINDS, "pages")


def write_layouts(items: DataFrame, path: str) -> None:
    """Items (as `items` gives them) as layouts, a document a line: the arrays in the order of at, a page for each that bears an item."""
    fields = ["label", "text", "marker", "content_layer", "prov", "captions", "data"]
    arrays = []
    for kind in KINDS:
        mine = F.array_sort(F.collect_list(F.when(F.col("kind") == kind[:-1], F.struct("at", F.struct(*fields).alias("x")))), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
        arrays.append(F.transform(mine, lambda y: y["x"]).alias(kind))
    size = F.lit(None).cast("struct<width:double,height:double>")
    pages = F.transform(F.array_sort(F.collect_set("page")), lambda n: F.struct(n.cast("string"), F.struct(size.alias("size"))))
    items.groupBy("doc").agg(*arrays, F.map_from_entries(pages).alias("pages")).write.json(path)


def items(layout: DataFrame) -> DataFrame:
    """One row for each placed item: doc, kind, at (place in its array), page, box and the item's fields. Items without a place are left out."""
    out = None
    for k, kind in enumerate(KINDS):
        one = layout.select("doc", F.posexplode_outer(kind).alias("at", "x")).filter("x IS NOT NULL AND size(x.prov) > 0")
        p = F.col("x.prov")[0]
        one = one.select("doc", F.lit(kind[:-1]).alias("kind"), F.lit(k).alias("kind_order"), "at", F.coalesce(p["page_no"], F.lit(0)).alias("page"), p["bbox"].alias("bbox"), "x.label", "x.text", "x.marker", "x.content_layer", "x.captions", "x.data", "x.prov")
        out = one if out is None else out.unionByName(one)
    return out


def page_counts(layout: DataFrame) -> DataFrame:
    return layout.select("doc", F.coalesce(F.size("pages"), F.lit(0)).alias("n"))


def read_pipeline(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page_from, page_to) of OCR ranges; a record of the ocr profile without ranges is an error."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.pipeline\.json$", 1)
    raw = spark.read.schema("profile string, ocr_page_ranges array<array<int>>").option("multiLine", True).option("pathGlobFilter", "*.pipeline.json").json(path)
    return _ranges(raw.select(name.alias("doc"), "profile", "ocr_page_ranges"))


def read_pipelines(spark: SparkSession, path: str) -> DataFrame:
    """As read_pipeline, of files that hold a document a line."""
    return _ranges(spark.read.schema("doc string, profile string, ocr_page_ranges array<array<int>>").json(path))


def write_pipelines(provenance: DataFrame, path: str) -> None:
    """Ranges (doc, page_from, page_to, source) as records of how documents were read, a document a line."""
    ocr = F.array_sort(F.collect_list(F.when(F.col("source") == "ocr", F.array("page_from", "page_to"))))
    rows = provenance.groupBy("doc").agg(ocr.alias("ocr_page_ranges"))
    rows.select("doc", F.when(F.size("ocr_page_ranges") > 0, "ocr").otherwise("native").alias("profile"), "ocr_page_ranges").write.json(path)


def _ranges(raw: DataFrame) -> DataFrame:
    name = F.col("doc")
    ranges = F.when(F.coalesce(F.size("ocr_page_ranges"), F.lit(0)) <= 0, F.raise_error(F.concat(F.lit("no OCR ranges in "), name)).cast("array<array<int>>")).otherwise(F.col("ocr_page_ranges"))
    rows = raw.filter("profile = 'ocr'").select("doc", ranges.alias("r"))
    return rows.select("doc", F.explode_outer("r").alias("x")).select("doc", F.col("x")[0].alias("page_from"), F.col("x")[1].alias("page_to"))
