"""Records and provenance as tab-separated files without quoting. Absence is the empty string, never null."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import ranked

# --- fixed values: the columns of both files ---
RECORDS = ["id", "doc", "page", "cite", "parent_id", "label", "text", "norm"]
PROVENANCE = ["doc", "page_from", "page_to", "source"]
NUMBERS = {"page", "page_from", "page_to"}


class CorpusError(ValueError):
    """A file that can't be loaded whole."""


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """line (int, from 2) and the columns. A missing or empty file, a wrong header, a ragged line and a number that is none are errors, told with their line.

    A path may be a folder of files, as `write_tsv` makes it: lines count through all of them in the order of their names.
    """
    place = ("_metadata.file_name", "_metadata.file_block_start")
    raw = ranked(spark.read.text(path).select("value", *(F.col(c).alias(f"p{i}") for i, c in enumerate(place)), F.monotonically_increasing_id().alias("p2")), "p0", "p1", "p2", name="line")
    first = raw.filter("line = 1").first()
    if first is None:
        raise CorpusError(f"{path} is empty")
    if first["value"].rstrip("\r").split("\t") != columns:
        raise CorpusError(f"{path} doesn't have the columns {', '.join(columns)}")
    fields = F.split(F.rtrim(F.col("value"), F.lit("\r")), "\t", -1)
    # filters of a query may run before the one on the header: its line must not be judged
    wrong = lambda what: F.when(F.col("line") > 1, F.raise_error(F.concat(F.lit(f"{path}, line "), F.col("line").cast("string"), F.lit(f": {what}"))))
    rows = raw.filter("line > 1").select("line", fields.alias("f"))
    rows = rows.select("line", F.when(F.size("f") == len(columns), F.col("f")).otherwise(wrong(f"another number of fields than {len(columns)}").cast("array<string>")).alias("f"))
    number = lambda c, name: F.when(c.try_cast("int").isNotNull(), c.try_cast("int")).otherwise(wrong(f"{name} is no number").cast("int"))
    return rows.select("line", *((number(F.col("f")[i], c) if c in NUMBERS else F.col("f")[i]).alias(c) for i, c in enumerate(columns)))


def load(spark: SparkSession, path: str, provenance: str | None = None, check_ids: bool = True) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The records of a corpus file in reading order (seq); an id that is there twice is an error. With a provenance file, both tables."""
    rows = read_tsv(spark, path, RECORDS).withColumnRenamed("line", "seq")
    if check_ids and (twice := rows.groupBy("id").count().filter("count > 1").first()):
        raise CorpusError(f"{path} has the id {twice['id']} {twice['count']} times")
    return rows if provenance is None else (rows, read_tsv(spark, provenance, PROVENANCE).drop("line"))


def write_tsv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A folder whose files, in the order of their names, are a header and then the rows by ranges of the order. Tabs and line breaks inside fields become spaces."""
    fields = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n\r", "   ") for c in columns]
    head = rows.sparkSession.createDataFrame([("\t".join(columns),)], "value string").coalesce(1)
    head.unionByName(rows.orderBy(*order).select(F.concat_ws("\t", *fields).alias("value"))).write.mode("overwrite").text(path)


def write_corpus(records: DataFrame, provenance: DataFrame, folder: str) -> None:
    """Both files of a corpus: records in reading order, and ranges by document and page."""
    write_tsv(records, f"{folder}/corpus.tsv", RECORDS, ["seq"])
    write_tsv(provenance, f"{folder}/corpus.provenance.tsv", PROVENANCE, ["doc", "page_from"])


def write_parquet(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """The stored form: documents dealt over a fixed number of folders by hash, so that reads of one document prune the others, however many there are."""
    part = F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", part).repartitionByRange("bucket", "doc", "seq").sortWithinPartitions("bucket", "doc", "seq").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_parquet(spark: SparkSession, path: str, doc: str | None = None, buckets: int = 64) -> DataFrame:
    rows = spark.read.parquet(path)
    if doc is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(doc)), F.lit(buckets)).cast("int").alias("b")).first()["b"]
        rows = rows.filter((F.col("bucket") == bucket) & (F.col("doc") == doc))
    return rows.drop("bucket")


def promote(rows: DataFrame, path: str, gate, accept: bool = False) -> bool:
    """Writes a new version and makes it the current one only if the gate (staged rows to failures) finds nothing, or what it finds is accepted.

    Versions stay. A pointer file names the current one, and is replaced in one step: readers see the old version or the new one.
    """
    spark, name = rows.sparkSession, f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    if gate(spark.read.parquet(f"{path}/{name}")).limit(1).count() and not accept:
        return False
    jvm = spark.sparkContext._jvm
    new, there = jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt.{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, there, options)
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that was promoted last."""
    names = [r["value"] for r in spark.read.text(f"{path}/current.txt").collect()]  # one line
    return spark.read.parquet(f"{path}/{names[0]}")
