"""The shared folder: tables that a plan writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a session of one machine (a test) may leave that setting out and gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's part of the shared folder, which goes when the session ends."""
    mine = f"{shared_root(spark)}/foliant-{spark.sparkContext.applicationId}"
    fs, at = _files(spark, mine)
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return f"{mine}/{name}-{uuid.uuid4().hex}"


def dropped(*tables: DataFrame) -> None:
    """Removes what `stored` wrote for these tables. Nothing may read them any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, at = _files(df.sparkSession, folder)
            fs.delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task may number.
FEW = 10_000


def ranked(df: DataFrame, *order, name: str = "rank", kind: str = "int") -> DataFrame:
    """The rows with their place (from 1) in an order of all rows.

    Rows are sorted by ranges and numbered within each; what is added up over all is one count a range, so no task holds all rows, unless
    they are counted and few.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    at, part = "__rank_at", "__rank_part"
    rows = stored(df, "unranked")
    if rows.limit(FEW + 1).count() <= FEW:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast(kind))
    rows = stored(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(part).agg(F.count("*").alias("__rank_n"))
    before = counts.select(part, (F.sum("__rank_n").over(Window.orderBy(part)) - F.col("__rank_n")).alias("__rank_before"))
    place = (F.col("__rank_before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).cast(kind)
    return rows.join(F.broadcast(before), part).withColumn(name, place).drop(at, part, "__rank_before")


def state(spark: SparkSession, path: str) -> tuple:
    """What tells a file or a folder of files from its former states: length and time of a file, count and hashes of names, lengths and times of many."""
    from pyspark.sql import functions as F

    fs, at = _files(spark, path)
    if fs.isFile(at):
        status = fs.getFileStatus(at)
        return (status.getLen(), status.getModificationTime())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    hashed = files.select("length", (F.xxhash64("path", "length", "modificationTime") % (1 << 40)).alias("h"))
    return tuple(hashed.agg(F.count("*"), F.sum("length"), F.sum("h"), F.bit_xor("h")).first())


def there(spark: SparkSession, path: str) -> bool:
    """Whether a table that `stored` or a writer made is still whole."""
    fs, at = _files(spark, f"{path}/_SUCCESS")
    return fs.exists(at)
