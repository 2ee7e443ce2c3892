"""Quoted tables of questions and answers, and documents that are converted once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored


class GoldError(ValueError):
    """Questions and answers that don't line up."""


def read_gold(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a quoted CSV with a header, as strings; rows that are empty throughout are left out. Fields may hold quotes and line breaks."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000").option("ignoreLeadingWhiteSpace", False).option("lineSep", "\n").csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise GoldError(f"{path} lacks the columns {', '.join(missing)}")
    some = F.lit(False)
    for c in columns:
        some = some | (F.coalesce(c, F.lit("")) != "")
    return raw.filter(some).select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def write_gold(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def gold_set(spark: SparkSession, questions: str, answers: str) -> DataFrame:
    """set, number, question, answer, sources; an error if one side lacks a key of the other."""
    q, a = read_gold(spark, questions, ["set", "number", "question"]), read_gold(spark, answers, ["set", "number", "answer", "sources"])
    apart = q.select("set", "number").exceptAll(a.select("set", "number")).withColumn("side", F.lit("answers")).unionByName(a.select("set", "number").exceptAll(q.select("set", "number")).withColumn("side", F.lit("questions")))
    if odd := apart.orderBy("side", "set", "number").first():
        raise GoldError(f"missing {odd['side']} for {odd['set']}-{odd['number']}")
    return q.join(a, ["set", "number"])


def convert_all(documents: DataFrame, there: DataFrame, convert: Callable[[str], None], force: bool = False) -> DataFrame:
    """(doc, status, error): a manifest of a run over documents (doc). What is there (doc) is skipped unless forced; the others are converted in tasks, and a failure
    is recorded while the run goes on. A task that runs again converts its documents again. The manifest is stored; reading it converts nothing."""
    names = documents.select("doc").distinct()
    todo = names if force else names.join(there.select("doc").distinct(), "doc", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, errors = [], []
            for name in batch.column("doc").to_pylist():
                try:
                    convert(name)
                    status.append("converted")
                    errors.append("")
                except Exception as e:  # noqa: BLE001  the manifest is where it is told
                    status.append("failed")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(status, pa.string()), pa.array(errors, pa.string())], ["doc", "status", "error"])

    out = todo.mapInArrow(run, "doc string, status string, error string")
    if not force:
        out = out.unionByName(names.join(there.select("doc").distinct(), "doc", "left_semi").select("doc", F.lit("skipped").alias("status"), F.lit("").alias("error")))
    return stored(out, "manifest")
