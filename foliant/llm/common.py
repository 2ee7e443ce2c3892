"""What several operators share: words, folds of documents, shared storage."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import dropped, ranked, shared_path, shared_root, stored

__all__ = ["ascii_lower", "dropped", "fold", "map_rows", "named", "ranked", "shared_path", "shared_root", "stored", "table", "tidy", "words"]

#: White space that parts words: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes that a worker may hold between tasks without giving any back.
KEPT, PAGE = 128 << 20, os.sysconf("SC_PAGE_SIZE")
#: Rows of an Arrow batch in place of Spark's default of 10,000: whole texts are rows of some kilobytes, and each task holds a few batches on both sides.
BATCH, ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), "2000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: Column) -> Column:
    """The words of a text in order; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key gives null, which is in no fold."""
    return F.crc32(key.cast("string").cast("binary")) % n


def resident() -> int:
    """Bytes of memory that this process holds (all of it counts as much where the system doesn't tell)."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * PAGE
    except OSError:
        return KEPT + 1


def tidy(f: Callable) -> Callable:
    """Wraps a function over Arrow batches: when its task ends, what the worker no longer uses goes back to the system.

    Workers serve many tasks of many queries; else each keeps the most that any of them needed. Small workers have nothing to give.
    The session's batches are made smaller, unless it sets their size itself.
    """
    session = SparkSession.getActiveSession()
    if session and session.conf.get(*BATCH) == BATCH[1]:
        session.conf.set(BATCH[0], ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.enable()
            if resident() > KEPT:
                gc.collect()
                pa.default_memory_pool().release_unused()
                try:
                    ctypes.CDLL(None).malloc_trim(0)
                except (AttributeError, OSError):  # another C library
                    pass

    return run


def map_rows(df: DataFrame, f: Callable, schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any names, dots included; f sees and gives the real ones."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(b.rename_columns(names) for b in batches):
            yield out.rename_columns([f"o{i}" for i in range(out.num_columns)])

    plain = T.StructType([T.StructField(f"o{i}", c.dataType, c.nullable) for i, c in enumerate(schema)])
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(tidy(run), plain).toDF(*schema.names)
