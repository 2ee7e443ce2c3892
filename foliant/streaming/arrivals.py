"""New documents as a stream: each arriving file becomes records, committed batch by batch, and finished batches are merged into one table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import build
from ..sources.layout import KINDS, SCHEMA, items
from ..sources.tsv import current, promote


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the records of every new layout file in a folder. Documents are independent, so no state is kept between batches."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    stream = spark.readStream.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select(name.alias("doc"), *KINDS, "pages")

    def batch(rows: DataFrame, number: int) -> None:
        # one folder a batch: a batch that runs again after a failure replaces its own rows
        build(items(rows)).write.mode("overwrite").parquet(f"{out}/batches/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def arrived(spark: SparkSession, out: str) -> DataFrame:
    """All records so far: the merged table, and the batches that came after it."""
    new = spark.read.parquet(f"{out}/batches")
    try:
        whole = current(spark, f"{out}/merged")
    except AnalysisException:  # nothing was merged yet
        return new
    upto = whole.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    return whole.unionByName(new.filter(F.col("batch") > upto))


def compact(spark: SparkSession, out: str) -> DataFrame:
    """Merges all finished batches into a new version of one table, and returns it. Folders of merged batches may go once no reader uses them."""
    rows = arrived(spark, out)
    promote(rows.repartitionByRange("doc", "seq"), f"{out}/merged", lambda staged: staged.filter("id IS NULL"))
    return current(spark, f"{out}/merged")
