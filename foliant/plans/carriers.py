"""The driver's tables in the shape of records, provenance, boxes and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HEADING_LENGTH, collapse, normalize
from ..operators.order import order_labels
from ..operators.search import write_postings
from ..storage import ranked, shared_path, state, there

LINES = 10
#: Lines that the numbering of a document has room for.
PLACES = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a few files dealt over all cores: a small table may be one row group, which one task reads. Tables of many files stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def doc_name(number: F.Column) -> F.Column:
    """A document's name: its number in base 36, in three places or as many as it has. Names never coincide; codes, their first three places, can."""
    name = F.conv(number, 10, 36)
    return F.lpad(name, F.greatest(F.lit(3), F.length(name)), "0")


def rec_docs(spark: SparkSession, sf_dir: str, with_norm: bool = True) -> DataFrame:
    """Lines of documents: line 0 is the root, the others its children; ten lines make a page."""
    lines = dealt(read(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))).filter("pos IS NOT NULL")
    doc = F.concat(F.lit("D"), F.col("doc_id"))
    page = F.floor(F.col("pos") / LINES).cast("int") + 1
    out = lines.select(
        F.when(F.col("pos") < PLACES, F.col("doc_id") * PLACES + F.col("pos")).otherwise(F.raise_error(F.lit("a document of a million lines or more"))).alias("seq"),
        F.concat(doc, F.lit(":p"), page, F.lit(":§"), F.col("pos") % LINES + 1).alias("id"),
        doc.alias("doc"),
        page.alias("page"),
        F.when(F.col("pos") == 0, "").otherwise(F.concat(F.lit("A."), F.col("pos") % 7)).alias("cite"),
        F.when(F.col("pos") == 0, "").otherwise(F.concat(doc, F.lit(":p1:§1"))).alias("parent_id"),
        F.when(F.col("pos") == 0, "section_header").otherwise("text").alias("label"),
        collapse(F.col("line")).alias("text"),
    )
    return out.withColumn("norm", normalize(F.col("text"))) if with_norm else out


_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build) -> DataFrame:
    """A table that `build` writes to a path, built once for a session and a state of the tables behind it, as an ingest builds its records once."""
    key = (spark.sparkContext.applicationId, sf_dir, name, *(state(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in _KEPT or not there(spark, _KEPT[key]):
        path = shared_path(spark, name)
        build(path)
        _KEPT[key] = path
    return spark.read.parquet(_KEPT[key])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of `rec_docs`, norm included, as every search reads them."""
    return kept(spark, sf_dir, "corpus", ["documents"], rec_docs(spark, sf_dir).write.option("compression", "zstd").parquet)


def term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of `rec_docs` with their places, as `search.postings` lays them out. The records themselves aren't stored for it."""
    return kept(spark, sf_dir, "terms", ["documents"], lambda path: write_postings(rec_docs(spark, sf_dir), path))


def hier_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of `hier`, stored."""
    return kept(spark, sf_dir, "hier", ["region", "nation", "customer", "orders"], hier(spark, sf_dir).write.parquet)


def hier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the records of `hier` by their places in the hierarchy, stored in order."""
    return kept(spark, sf_dir, "labels", ["region", "nation", "customer", "orders"], lambda path: order_labels(hier_corpus(spark, sf_dir)).repartitionByRange("pre").sortWithinPartitions("pre").write.parquet(path))


def build_corpus(spark: SparkSession, sf_dir: str) -> str:
    """Writes the records and their term index, and returns the records' path."""
    path = shared_path(spark, "corpus")
    rec_docs(spark, sf_dir).write.option("compression", "zstd").parquet(path)
    write_postings(spark.read.parquet(path), shared_path(spark, "terms"))
    return path


#: Levels of each chain of `line_chain`.
LEVELS = 10_000


def line_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in chains of `LEVELS` levels: each stands under the line before it."""
    rows = ranked(corpus(spark, sf_dir).select("seq", "id"), "seq", name="n", kind="long")
    before = rows.select((F.col("n") + 1).alias("n"), F.col("id").alias("before"))
    parent = F.when(F.col("n") % LEVELS == 1, "").otherwise(F.coalesce("before", F.lit("")))
    return rows.join(before, "n", "left").select("seq", "id", parent.alias("parent_id"))


SQL_DOCS = """
lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
records AS (SELECT doc_id * 1000000 + pos AS seq, 'D' || doc_id || ':p' || (pos // 10 + 1) || ':§' || (pos % 10 + 1) AS id, 'D' || doc_id AS doc,
  CAST(pos // 10 + 1 AS INTEGER) AS page, CASE WHEN pos = 0 THEN '' ELSE 'A.' || (pos % 7) END AS cite,
  CASE WHEN pos = 0 THEN '' ELSE 'D' || doc_id || ':p1:§1' END AS parent_id, CASE WHEN pos = 0 THEN 'section_header' ELSE 'text' END AS label,
  trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g')) AS text,
  regexp_replace(strip_accents(lower(trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g')))), '(^|[^\\p{L}\\p{N}_])m\\s*[²2?]', '\\1m2', 'g') AS norm FROM lines)
"""


def rec_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: the first is the root, the others its children."""
    t = read(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    doc = F.concat(F.lit("C"), F.col("conv_id"))
    text = collapse(F.coalesce("text", F.lit("")))
    return t.select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"),
        F.concat(doc, F.lit(":p1:§"), F.col("turn")).alias("id"),
        doc.alias("doc"),
        F.lit(1).alias("page"),
        F.lit("").alias("cite"),
        F.when(F.col("turn") == 0, "").otherwise(F.concat(doc, F.lit(":p1:§0"))).alias("parent_id"),
        F.when(F.col("turn") == 0, "section_header").otherwise("text").alias("label"),
        text.alias("text"),
        normalize(text).alias("norm"),
    )


def hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer and order as a hierarchy of four levels."""
    region, nation, customer, orders = (read(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders"))
    rows = [
        region.select(F.col("r_regionkey").cast("long").alias("k"), F.lit("R").alias("t"), F.lit("").alias("p"), F.col("r_name").alias("text"), F.lit(0).alias("lvl")),
        nation.select(F.col("n_nationkey").cast("long"), F.lit("N"), F.concat(F.lit("H:p1:R"), "n_regionkey"), "n_name", F.lit(1)),
        customer.select(F.col("c_custkey").cast("long"), F.lit("C"), F.concat(F.lit("H:p1:N"), "c_nationkey"), "c_name", F.lit(2)),
        orders.select(F.col("o_orderkey").cast("long"), F.lit("O"), F.concat(F.lit("H:p1:C"), "o_custkey"), F.concat(F.lit("order "), "o_orderkey"), F.lit(3)),
    ]
    u = rows[0]
    for r in rows[1:]:
        u = u.union(r)
    return u.select(
        (F.col("lvl") * F.lit(10**12) + F.col("k")).alias("seq"), F.concat(F.lit("H:p1:"), "t", "k").alias("id"), F.lit("H").alias("doc"), F.lit(1).alias("page"),
        F.lit("").alias("cite"), F.col("p").alias("parent_id"), F.when(F.col("lvl") < 2, "section_header").otherwise("text").alias("label"), "text", F.lower("text").alias("norm"),
    )


def hier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy with line items as its fifth level."""
    x = read(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").select(F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    text = F.concat(F.lit("line "), "n")
    return hier(spark, sf_dir).unionByName(x.select(
        (F.lit(4 * 10**12) + F.col("o") * 100 + F.col("n")).alias("seq"), F.concat(F.lit("H:p1:L"), "o", F.lit("-"), "n").alias("id"), F.lit("H").alias("doc"), F.lit(1).alias("page"),
        F.lit("").alias("cite"), F.concat(F.lit("H:p1:O"), "o").alias("parent_id"), F.lit("text").alias("label"), text.alias("text"), text.alias("norm"),
    ))


SQL_HIER = """
hier AS (SELECT 'H:p1:R' || r_regionkey AS id, '' AS parent_id, r_name AS text, 'section_header' AS label FROM region
 UNION ALL SELECT 'H:p1:N' || n_nationkey, 'H:p1:R' || n_regionkey, n_name, 'section_header' FROM nation
 UNION ALL SELECT 'H:p1:C' || c_custkey, 'H:p1:N' || c_nationkey, c_name, 'text' FROM customer
 UNION ALL SELECT 'H:p1:O' || o_orderkey, 'H:p1:C' || o_custkey, 'order ' || o_orderkey, 'text' FROM orders),
up AS (SELECT id, parent_id AS ancestor_id, 1 AS distance FROM hier WHERE parent_id IN (SELECT id FROM hier)
 UNION ALL SELECT up.id, h.parent_id, distance + 1 FROM up JOIN hier h ON h.id = up.ancestor_id WHERE h.parent_id IN (SELECT id FROM hier))
"""


SQL_HIER_LINES = SQL_HIER.replace(
    " FROM orders),",
    """ FROM orders
 UNION ALL SELECT DISTINCT 'H:p1:L' || l_orderkey || '-' || l_linenumber, 'H:p1:O' || l_orderkey, 'line ' || l_linenumber, 'text' FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL),""",
)


def prov(records: DataFrame) -> DataFrame:
    """A range for each document; every third one has an OCR range before its native pages."""
    last = records.groupBy("doc").agg(F.max("page").alias("n"))
    third = F.substring("doc", 2, 18).cast("long") % 3 == 0
    mid = F.floor((F.col("n") + 1) / 2).cast("int")
    parts = F.when(third & (F.col("n") > 1), F.array(F.struct(F.lit(1).alias("page_from"), mid.alias("page_to"), F.lit("ocr").alias("source")), F.struct((mid + 1).alias("page_from"), F.col("n").alias("page_to"), F.lit("native").alias("source")))).otherwise(
        F.array(F.struct(F.lit(1).alias("page_from"), F.col("n").alias("page_to"), F.lit("native").alias("source")))
    )
    return last.select("doc", F.explode_outer(parts).alias("r")).select("doc", "r.page_from", "r.page_to", "r.source")


SQL_PROV = """
ends AS (SELECT doc, max(page) AS n FROM records GROUP BY doc),
prov AS (SELECT doc, 1 AS page_from, (n + 1) // 2 AS page_to, 'ocr' AS source FROM ends WHERE CAST(substr(doc, 2) AS BIGINT) % 3 = 0 AND n > 1
 UNION ALL SELECT doc, (n + 1) // 2 + 1, n, 'native' FROM ends WHERE CAST(substr(doc, 2) AS BIGINT) % 3 = 0 AND n > 1
 UNION ALL SELECT doc, 1, n, 'native' FROM ends WHERE NOT (CAST(substr(doc, 2) AS BIGINT) % 3 = 0 AND n > 1))
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on the page of their order: kind, label, corners and line band."""
    x = read(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL")
    k, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    key = k * 10 + n
    left, top = (k % 400).cast("double"), ((k * 7 + n * 131) % 700).cast("double")
    big = n % 3 == 0
    wide, high = F.when(big, 320.0).otherwise((k % 60 + 5).cast("double")), F.when(big, 300.0).otherwise(10.0)
    return x.select(
        F.col("l_orderkey").alias("page"), key.alias("n"), F.when(big, F.when(k % 2 == 0, "picture").otherwise("table")).otherwise("text").alias("kind"),
        F.when(k % 5 == 0, "section_header").when(k % 5 == 1, "caption").when(k % 5 == 2, "list_item").otherwise("text").alias("label"),
        left.alias("l"), (left + wide).alias("r"), top.alias("t"), (top - high).alias("b"),
    )


SQL_BOXES = """
raw AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS k FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL),
boxes AS (SELECT page, k * 10 + n AS n, CASE WHEN n % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'picture' ELSE 'table' END ELSE 'text' END AS kind,
 CASE k % 5 WHEN 0 THEN 'section_header' WHEN 1 THEN 'caption' WHEN 2 THEN 'list_item' ELSE 'text' END AS label,
 CAST(k % 400 AS DOUBLE) AS l, CAST(k % 400 + CASE WHEN n % 3 = 0 THEN 320 ELSE k % 60 + 5 END AS DOUBLE) AS r,
 CAST((k * 7 + n * 131) % 700 AS DOUBLE) AS t, CAST((k * 7 + n * 131) % 700 - CASE WHEN n % 3 = 0 THEN 300 ELSE 10 END AS DOUBLE) AS b FROM raw)
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the word table of an optical reading of their order's page, in two blocks of three lines."""
    x = read(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL")
    k, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    kinds = [F.concat((k % 20).cast("string"), F.lit(".")), F.concat(F.chr(k % 5 + 97), F.lit(")")), F.lit("≥"), F.lit("¢)"), F.lit("  "), F.lit("m²"), F.concat(F.lit("w"), (k % 100).cast("string"))]
    text = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        text = F.when(k % 8 == i, kind).otherwise(text)
    number = lambda c: c.cast("int")
    return x.select(
        F.col("l_orderkey").alias("page"), (k * 10 + n).alias("n"), number(n % 2).alias("block_num"), F.lit(1).alias("par_num"), number(n % 3).alias("line_num"), number((k * 13) % 2000).alias("left"),
        number((n % 3) * 120 + k % 7).alias("top"), number(k % 120 + 10).alias("width"), number(k % 9 + 20).alias("height"), ((k * 37 + n) % 100).cast("double").alias("conf"), text.alias("text"),
    )


SQL_WORDS = """
words AS (SELECT page, k * 10 + n AS n, n % 2 AS block_num, 1 AS par_num, n % 3 AS line_num, (k * 13) % 2000 AS x, (n % 3) * 120 + k % 7 AS y, k % 120 + 10 AS w, k % 9 + 20 AS h, CAST((k * 37 + n) % 100 AS DOUBLE) AS conf,
 CASE k % 8 WHEN 0 THEN (k % 20) || '.' WHEN 1 THEN chr(CAST(97 + k % 5 AS INTEGER)) || ')' WHEN 2 THEN '≥' WHEN 3 THEN '¢)' WHEN 4 THEN '  ' WHEN 5 THEN 'm²' ELSE 'w' || (k % 100) END AS text
 FROM (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS k FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL)),
lines AS (SELECT page, block_num, par_num, line_num, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, string_agg(trim(text), ' ' ORDER BY x, n) AS text FROM words WHERE trim(text) <> '' AND conf >= 40 GROUP BY ALL)
"""


def pixel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other line item as a laid-out item of the same page, its box in pixels."""
    x = read(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL AND l_linenumber % 2 = 0")
    k, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    left, top = ((k * 29) % 1500).cast("double"), ((n % 3) * 120 - 5 + k % 11).cast("double")
    # the text begins the row that the item stands on, often enough
    return x.select(F.col("l_orderkey").alias("page"), (k * 10 + n).alias("n"), left.alias("left"), (left + 200 + k % 300).alias("right"), top.alias("top"), (top + 25 + (k % 4) * 20).alias("bottom"), F.when(k % 2 == 0, "w").otherwise("m²").alias("text"))


SQL_PIXELS = """
items AS (SELECT page, k * 10 + n AS n, CAST((k * 29) % 1500 AS DOUBLE) AS x0, CAST((k * 29) % 1500 + 200 + k % 300 AS DOUBLE) AS x1, CAST((n % 3) * 120 - 5 + k % 11 AS DOUBLE) AS y0, CAST((n % 3) * 120 + 20 + k % 11 + (k % 4) * 20 AS DOUBLE) AS y1,
 CASE WHEN k % 2 = 0 THEN 'w' ELSE 'm²' END AS text FROM (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS k FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber % 2 = 0)),
rows AS (SELECT l.page, l.block_num, l.par_num, l.line_num, i.n FROM lines l JOIN items i ON i.page = l.page AND least(l.y1, i.y1) - greatest(l.y0, i.y0) > 0.5 * greatest(1.0, l.y1 - l.y0))
"""


#: Numbers of boxes that a page of `layout_items` has room for.
ROOM = 10**15


def layout_items(spark: SparkSession, sf_dir: str, cited: bool = True) -> DataFrame:
    """Boxes as items of a layout: fifty pages make a document. Some texts are empty, running headers, furniture or (if cited) headings in disguise."""
    b = boxes(spark, sf_dir)
    k, text = F.floor(F.col("n") / 10), F.col("kind") == "text"
    box = F.struct("l", "r", "t", "b", F.lit("BOTTOMLEFT").alias("coord_origin"))
    page = (F.col("page") % 50 + 1).cast("int")
    label = F.when(text & (k % 17 == 0), "page_header").when(~F.lit(cited) & (F.col("label") == "list_item"), "text").otherwise(F.col("label"))
    words = F.when(k % 11 == 0, " ").when(k % 11 == 1, "DOG Núm. 12").when(F.lit(cited) & (k % 11 == 2), F.concat(F.lit("B.2."), k % 9, F.lit(" Heading"))).otherwise(F.concat(F.lit("Item "), F.col("n")))
    cell = lambda c, t: F.struct(F.lit(0).alias("start_row_offset_idx"), F.lit(c).alias("start_col_offset_idx"), t.alias("text"))
    grid = F.struct(F.lit(1).alias("num_rows"), F.lit(2).alias("num_cols"), F.when(k % 4 == 1, F.array(cell(0, F.lit("a")), cell(1, F.col("n").cast("string")))).alias("table_cells"))
    kinds = F.when(F.col("kind") == "text", 0).when(F.col("kind") == "table", 1).otherwise(2)
    return b.select(
        doc_name(F.floor(F.col("page") / 50)).alias("doc"), "kind", kinds.alias("kind_order"), (F.col("page") % 50 * ROOM + F.col("n")).alias("at"), page.alias("page"), box.alias("bbox"), label.alias("label"), F.when(text, words).alias("text"),
        F.lit(None).cast("string").alias("marker"), F.when(k % 13 == 0, "furniture").otherwise("body").alias("content_layer"), F.lit(None).cast("array<struct<text:string>>").alias("captions"), F.when(F.col("kind") == "table", grid).alias("data"),
        F.array(F.struct(page.alias("page_no"), box.alias("bbox"))).alias("prov"), F.col("page").alias("order"),
    )


SQL_ITEMS = """
it AS (SELECT page, n, kind, l, r, t, b, label AS own, n // 10 AS k, CASE WHEN kind = 'text' AND n // 10 % 17 = 0 THEN 'page_header' ELSE label END AS label,
 CASE WHEN n // 10 % 13 = 0 THEN 'furniture' ELSE 'body' END AS layer, CASE kind WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END AS kind_order FROM boxes),
fig AS (SELECT * FROM it o WHERE kind = 'picture' AND NOT EXISTS (SELECT 1 FROM it x WHERE x.kind = 'text' AND x.label IN (HEADS) AND INSIDE)),
judged AS (SELECT *, CASE WHEN label = 'page_header' OR layer = 'furniture' THEN 'furniture'
 WHEN kind = 'text' AND label <> 'caption' AND EXISTS (SELECT 1 FROM fig o WHERE INSIDE) THEN 'figure_labels'
 WHEN kind = 'text' AND EXISTS (SELECT 1 FROM it o WHERE o.kind = 'table' AND INSIDE) THEN 'in_table'
 WHEN kind = 'table' AND k % 4 <> 1 THEN 'tables_skipped' WHEN kind = 'text' AND k % 11 = 0 THEN 'empty' WHEN kind = 'text' AND k % 11 = 1 THEN 'running_header' END AS dropped FROM it x)
""".replace("INSIDE", "x.page = o.page AND x.l >= o.l - 2 AND x.r <= o.r + 2 AND least(x.t, x.b) >= least(o.t, o.b) - 2 AND greatest(x.t, x.b) <= greatest(o.t, o.b) + 2")


#: (label, marker, left, words before the line): the kinds of items of `numbered_items`. {p} is the place of the line, {a} a letter by its place.
NUMBERED = [
    ("section_header", None, 50, "Anejo {a} "), ("section_header", None, 50, "Sección SUA {p} "), ("section_header", None, 50, "Capítulo II "), ("section_header", None, 50, "Título III "), ("section_header", None, 50, "Artículo {p} "),
    ("section_header", None, 50, "{a}.1 "), ("section_header", None, 50, "{a}.1.2 "), ("section_header", None, 50, "{p}.4 "), ("section_header", None, 50, "Sin número "),
    ("list_item", "a)", 70, "Texto: "), ("list_item", "1.", 84, "Texto: "), ("list_item", None, 98, "b) Texto: "), ("text", None, 50, "Texto: "), ("text", "iv)", 50, "Texto: "), ("list_item", "c)", 84, "Texto: "), ("picture", None, 50, "4.2 Figura "), ("list_item", None, 70, "A.1.3 Rótulo"),
]
#: Queries about numbers alone see so much of a line, and nothing of one that is a heading in disguise.
_TAIL = "left(line, 40)"


def numbered_items(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Lines of documents (whole, or their beginnings) as items of layouts with printed numbers: cites of all seven shapes, namespaces, list items at three indents, markers, captions, numbers that come again."""
    lines = dealt(read(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))).filter("pos IS NOT NULL AND doc_id IS NOT NULL")
    x = lines.withColumn("line", collapse(F.col("line"))).withColumn("k", (F.col("doc_id") * 7 + F.col("pos") * F.col("pos") * 5 + F.col("pos")) % len(NUMBERED))
    x = x.withColumn("p", (F.col("pos") % 3).cast("string")).withColumn("a", F.chr(F.col("pos") % 2 + 65))

    def by_kind(value) -> F.Column:
        out = F.lit(None)
        for k, kind in enumerate(NUMBERED):
            v = value(*kind)
            out = F.when(F.col("k") == k, v) if not k else out.when(F.col("k") == k, v)
        return out

    def tail(lead: str) -> F.Column:
        disguised = lead.startswith("A.1.3")
        if whole:
            return F.concat(F.lit(" "), "line") if disguised else F.col("line")
        return F.lit("") if disguised else F.expr(_TAIL)

    words = by_kind(lambda label, marker, left, lead: F.concat(F.replace(F.replace(F.lit(lead), F.lit("{p}"), F.col("p")), F.lit("{a}"), F.col("a")), tail(lead)))
    label, marker, left = by_kind(lambda *v: F.lit(v[0])), by_kind(lambda *v: F.lit(v[1])), by_kind(lambda *v: F.lit(float(v[2])))
    page, top = (F.floor(F.col("pos") / 20) + 1).cast("int"), (F.lit(700.0) - F.col("pos") % 20 * 20)
    x = x.select(doc_name(F.col("doc_id")).alias("doc"), "pos", words.alias("words"), label.alias("label"), marker.alias("marker"), page.alias("page"), F.struct(left.alias("l"), (left + 30).alias("r"), top.alias("t"), (top - 10).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin")).alias("bbox"))
    picture = F.col("label") == "picture"
    cell = F.array(F.struct(F.lit(0).alias("start_row_offset_idx"), F.lit(0).alias("start_col_offset_idx"), F.lit("").alias("text")))
    return x.select(
        "doc", F.when(picture, "picture").otherwise("text").alias("kind"), F.when(picture, 2).otherwise(0).alias("kind_order"), F.col("pos").cast("long").alias("at"), "page", "bbox", F.when(~picture, F.col("label")).alias("label"), F.when(~picture, F.col("words")).alias("text"), "marker",
        F.lit("body").alias("content_layer"), F.when(picture, F.array(F.struct(F.col("words").alias("text")))).alias("captions"), F.struct(F.lit(None).cast("int").alias("num_rows"), F.lit(None).cast("int").alias("num_cols"), F.when(F.lit(False), cell).alias("table_cells")).alias("data"),
        F.array(F.struct(F.col("page").alias("page_no"), F.col("bbox"))).alias("prov"),
    )


def _numbered_sql(whole: bool = False) -> str:
    """The same items, and a step of the outline for each: open headings, open list items and the addresses given so far are lists that go along."""

    def by_kind(value) -> str:
        return "CASE k " + " ".join(f"WHEN {k} THEN {value(*kind)}" for k, kind in enumerate(NUMBERED)) + " END"

    def lead(label: str, marker: str | None, left: int, words: str) -> str:
        tail = (" || ' ' || line" if words.startswith("A.1.3") else " || line") if whole else "" if words.startswith("A.1.3") else " || left(line, 40)"
        return f"replace(replace('{words}', '{{p}}', p), '{{a}}', a)" + tail

    # a heading in disguise is one if it is short
    short = lambda yes, no: f"CASE WHEN length(body) <= {HEADING_LENGTH} THEN {yes} ELSE {no} END" if whole else yes

    cites = {"Anejo": ("'Anejo ' || a", "'anejo' || a", 1), "Sección": ("'Sección SUA ' || p", "'secSUA' || p", 1), "Capítulo": ("'Capítulo II'", "'capII'", 1), "Título": ("'Título III'", "'titIII'", 1), "Artículo": ("'Artículo ' || p", "'art' || p", 2)}

    def cite(label: str, marker: str | None, left: int, words: str) -> tuple[str, str, int | str]:
        """What is printed, its part of an address, and the rank: 0 of a number, 99 of a heading without one."""
        first = words.split()[0]
        if first in cites:
            return cites[first]
        if label == "section_header" and first != "Sin" or first in ("4.2", "A.1.3"):
            number = f"replace(replace('{first}', '{{p}}', p), '{{a}}', a)"
            if whole and first == "A.1.3":
                return short(number, "''"), short(number, "''"), short(0, 99)
            return number, number, 0
        if first == "b)":
            return "'b'", "'b'", 0
        return (f"'{marker}'", f"'{marker[:-1]}'", 0) if marker else ("''", "''", 99)

    return f"""
lined AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL),
kinded AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\\s\\p{{Z}}]+', ' ', 'g')) AS line, (doc_id * 7 + pos * pos * 5 + pos) % {len(NUMBERED)} AS k, CAST(pos % 3 AS VARCHAR) AS p, chr(CAST(pos % 2 + 65 AS INTEGER)) AS a FROM lined),
item AS (SELECT upper(lpad(to_base(doc_id, 36), 3, '0')) AS doc, doc_id, pos, CAST(pos // 20 + 1 AS INTEGER) AS page, trim(regexp_replace({by_kind(lead)}, '[\\s\\p{{Z}}]+', ' ', 'g')) AS body,
 {by_kind(lambda *v: f"'{v[0]}'" if not v[3].startswith('A.1.3') else short("'section_header'", f"'{v[0]}'"))} AS label, {by_kind(lambda *v: v[2])} AS l, {by_kind(lambda *v: cite(*v)[0])} AS cite, {by_kind(lambda *v: cite(*v)[1])} AS own, {by_kind(lambda *v: cite(*v)[2])} AS rank FROM kinded),
told AS (SELECT *, CASE WHEN own = '' THEN '§' || count(*) FILTER (WHERE own = '') OVER (PARTITION BY doc_id, page ORDER BY pos) ELSE own END AS path, string_split(own, '.') AS parts FROM item),
walk AS (SELECT doc_id, CAST(-1 AS BIGINT) AS pos, CAST([] AS STRUCT(parts VARCHAR[], rank INTEGER, id VARCHAR)[]) AS heads, CAST([] AS STRUCT(l INTEGER, id VARCHAR)[]) AS items, CAST([] AS VARCHAR[]) AS given, '' AS id, '' AS parent_id FROM told WHERE pos = 0
 UNION ALL SELECT doc_id, pos,
  CASE WHEN label = 'section_header' THEN heads[1 : h] || [{{'parts': parts, 'rank': rank, 'id': id}}] ELSE heads END,
  CASE WHEN label = 'section_header' THEN [] WHEN label = 'list_item' THEN items[1 : i] || [{{'l': l, 'id': id}}] ELSE items END, given || [address], id, parent_id
 FROM (SELECT *, address || CASE WHEN len(list_filter(given, lambda g: g = address)) > 0 THEN '~' || (len(list_filter(given, lambda g: g = address)) + 1) ELSE '' END AS id
  FROM (SELECT *, doc || ':p' || page || ':' || CASE WHEN label NOT IN ('section_header', 'picture') AND own <> '' AND above <> '' AND above[1] <> '§' THEN above || '.' || path ELSE path END AS address
   FROM (SELECT *, CASE WHEN parent_id = '' THEN '' ELSE regexp_extract(parent_id, '^[^:]*:[^:]*:(.*)$', 1) END AS above
    FROM (SELECT *, CASE WHEN label = 'section_header' THEN CASE WHEN h > 0 THEN heads[h].id ELSE '' END WHEN label = 'list_item' AND i > 0 THEN items[i].id WHEN len(heads) > 0 THEN heads[len(heads)].id ELSE '' END AS parent_id
     FROM (SELECT t.*, w.heads, w.items, w.given,
       coalesce(list_max(list_filter(range(1, len(w.heads) + 1), lambda j: NOT CASE WHEN t.rank = 99 THEN w.heads[j].rank = 99 WHEN t.rank > 0 THEN w.heads[j].rank = 0 OR w.heads[j].rank >= t.rank
         ELSE w.heads[j].rank = 99 OR (w.heads[j].rank = 0 AND NOT (len(w.heads[j].parts) < len(t.parts) AND t.parts[1 : len(w.heads[j].parts)] = w.heads[j].parts)) END)), 0) AS h,
       coalesce(list_max(list_filter(range(1, len(w.items) + 1), lambda j: w.items[j].l < t.l - 6)), 0) AS i
      FROM walk w JOIN told t ON t.doc_id = w.doc_id AND t.pos = w.pos + 1))))))
"""


SQL_NUMBERED, SQL_NUMBERED_WHOLE = _numbered_sql(), _numbered_sql(True)


def pointing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents whose texts point elsewhere: two of five lines name an article, a figure or a law."""
    k, t = F.col("seq") % 5, F.col("text")
    return rec_docs(spark, sf_dir, False).withColumn("text", F.when(k == 0, F.concat(F.lit("véase artículo "), F.col("seq") % 90, F.lit(" y figura 3 "), t)).when(k == 1, F.concat(F.lit("Anexo B de la Ley 39/2015, "), t)).otherwise(t))


SQL_POINTING = "pointing AS (SELECT * EXCLUDE (text, norm), CASE seq % 5 WHEN 0 THEN 'véase artículo ' || (seq % 90) || ' y figura 3 ' || text WHEN 1 THEN 'Anexo B de la Ley 39/2015, ' || text ELSE text END AS text FROM records)"
