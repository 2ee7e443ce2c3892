"""Shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet shards of about `small` bytes. Shards whose sizes lie in
the same power of `fan_in` form a tier; compaction merges runs of `fan_in` shards of a tier (fewer where the
target size is reached), round after round, until every tier below the target has fewer than `fan_in` left
in each slice. Rows keep their values; a merged shard holds its parts one after another.

A version is a table of entries (shard, rows, bytes) and one small JSON file that names it. The JSON file is created under
a name that must be free, so of two writers one wins and the other takes up the new version and tries again;
a version is seen whole or not at all, and old versions stay readable until `vacuum`.

Shards are named by job, task and content, and appear by renaming. A task that runs twice, or a job that
dies before its commit, leaves only files that no version names. Planning works on entries in slices of bounded
size, so neither the driver nor a task ever holds the entries of the whole store.

Edge cases: nulls, empty and long texts are kept as they are (a row beyond the target is a shard of its own);
repeated rows stay repeated; an empty table makes a version without shards that reads as an empty table;
all columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, named, shared_path, tidy
from .files import Store

SMALL, FAN_IN, TARGET = 4 << 20, 8, 32 << 20
ENTRY = "shard string, rows long, bytes long"


def _bytes_of(batch: pa.RecordBatch):
    """Bytes of each row: those of strings and binaries as they are, 8 for a number, and for nested columns what their values take on average in this batch."""
    total = None
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            n = pc.add(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), 4)
        elif pa.types.is_nested(column.type):
            n = pa.array([column.get_total_buffer_size() // max(1, len(column)) + 8] * len(column), pa.int64())
        else:
            n = pa.array([8] * len(column), pa.int64())
        total = n if total is None else pc.add(total, n)
    return total.to_pylist() if total is not None else [0] * len(batch)


def _save(store: Store, job: str, k: int, parts: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    """Writes shard k of this task; job, task, k and content make the name, so equal rows elsewhere are another shard."""
    out = io.BytesIO()
    table = pa.Table.from_batches(parts)
    pq.write_table(table, out, compression="zstd", row_group_size=1 << 16)
    data = out.getvalue()
    name = f"{job}-{TaskContext.get().partitionId():06d}-{k:05d}-{hashlib.sha256(data).hexdigest()[:16]}.parquet"
    store.write(name, data)
    return pa.RecordBatch.from_pydict({"shard": [name], "rows": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([size], pa.int64())})


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, small: int = SMALL, fan_in: int = FAN_IN, target: int = TARGET):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.small, self.fan_in, self.target = small, fan_in, target
        self.versions = Store(f"{folder}/versions")

    def latest(self) -> dict:
        names = [n for n in self.versions.names() if n.startswith("v")]
        return json.loads(self.versions.read(names[-1])) if names else {"version": 0, "entries": None, "rows": 0, "shards": 0}

    def entries(self, version: dict) -> DataFrame:
        if not version["entries"]:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(version["entries"])

    def commit(self, make) -> dict:
        """make(base version) gives the entries of the next one; tried again on the newer base if another writer was first."""
        while True:
            base = self.latest()
            path = f"{self.folder}/entries/{base['version'] + 1:08d}-{time.time_ns():x}"
            make(base).write.parquet(path)
            sums = self.spark.read.schema(ENTRY).parquet(path).agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
            new = {"version": base["version"] + 1, "entries": path, "shards": sums[0], "rows": sums[1]}
            if self.versions.create(f"v{new['version']:08d}.json", json.dumps(new).encode()):
                return new

    def append(self, rows: DataFrame) -> dict:
        """Writes the rows as small shards and commits them beside those of the version then current."""
        folder, small, job = f"{self.folder}/shards", self.small, uuid.uuid4().hex[:12]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, held, size, k = Store(folder), [], 0, 0
            for batch in batches:
                start = 0
                for i, n in enumerate(_bytes_of(batch)):
                    size += n
                    if size >= small:
                        held.append(batch.slice(start, i + 1 - start))
                        yield _save(store, job, k, held, size)
                        held, size, start, k = [], 0, i + 1, k + 1
                if start < len(batch):
                    held.append(batch.slice(start))
            if held:
                yield _save(store, job, k, held, size)

        path = f"{self.folder}/arrivals/{time.time_ns():x}"
        map_rows(rows.select(*(named(rows, c.name) for c in self.schema)), run, T._parse_datatype_string(ENTRY)).write.parquet(path)
        arrived = self.spark.read.schema(ENTRY).parquet(path)
        return self.commit(lambda base: self.entries(base).unionByName(arrived))

    def plan(self, entries: DataFrame, total: int) -> DataFrame:
        """(shard, rows, bytes, run): shards with a run number merge with those of the same run."""
        tier = F.floor(F.log(float(self.fan_in), F.greatest(F.col("bytes"), F.lit(1)) / F.lit(float(self.small)) + 0.5)).cast("int")
        slices = 1 + total // (self.target * 64)
        at = F.pmod(F.xxhash64("shard"), F.lit(slices)).cast("int")
        w = Window.partitionBy("tier", "slice").orderBy("bytes", "shard")
        rows = entries.withColumn("tier", tier).withColumn("slice", at).withColumn("k", F.row_number().over(w) - 1)
        rows = rows.withColumn("upto", F.sum("bytes").over(w) - F.col("bytes"))
        # a run ends after fan_in shards or where the target is reached, whichever comes first
        rows = rows.withColumn("run", F.when(F.col("bytes") < self.target, F.concat_ws("-", "tier", "slice", F.floor(F.col("k") / self.fan_in), F.floor(F.col("upto") / self.target))))
        size = Window.partitionBy("run")
        whole = (F.count("*").over(size) >= self.fan_in) | (F.sum("bytes").over(size) >= self.target * 0.9)
        return rows.withColumn("run", F.when(F.col("run").isNotNull() & whole & (F.count("*").over(size) > 1), F.col("run"))).select("shard", "rows", "bytes", "run")

    def compact(self) -> dict:
        """Merges until nothing is left to merge; each round commits a version."""
        folder, version = f"{self.folder}/shards", self.latest()
        while version["entries"]:
            entries = self.entries(version)
            total = entries.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
            path = f"{self.folder}/plans/{time.time_ns():x}"
            self.plan(entries, total).write.parquet(path)
            planned = self.spark.read.schema(ENTRY + ", run string").parquet(path)
            runs = planned.filter("run IS NOT NULL").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("shard", "bytes"))).alias("parts"))  # fan_in shards at most
            n = runs.count()
            if not n:
                break

            def run(batches: Iterator[pa.RecordBatch], job: str = uuid.uuid4().hex[:12]) -> Iterator[pa.RecordBatch]:
                store, k = Store(folder), 0
                for batch in batches:
                    for parts in batch.column("parts").to_pylist():
                        held = [b for p in parts for b in pq.read_table(io.BytesIO(store.read(p["shard"]))).to_batches()]
                        yield _save(store, job, k, held, sum(p["bytes"] for p in parts))
                        k += 1

            out = f"{self.folder}/merged/{time.time_ns():x}"
            runs.select("parts").repartition(min(n, 8192)).mapInArrow(tidy(run), ENTRY).write.parquet(out)
            merged = self.spark.read.schema(ENTRY).parquet(out)
            gone = planned.filter("run IS NOT NULL").select("shard")
            # entries that came meanwhile stay; those that another compaction took stop this one
            before = version["version"]

            def next_of(base: dict, gone=gone, merged=merged) -> DataFrame:
                now = self.entries(base)
                if base["version"] != before and gone.join(now, "shard", "left_anti").limit(1).count():
                    raise RuntimeError("another compaction has merged the same shards")
                return now.join(gone, "shard", "left_anti").select("shard", "rows", "bytes").unionByName(merged)

            version = self.commit(next_of)
        return version

    def read(self, version: dict | None = None) -> DataFrame:
        """The rows of a version (the latest if none is given)."""
        version = version or self.latest()
        folder, names = f"{self.folder}/shards", [c.name for c in self.schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = Store(folder)
            for batch in batches:
                for name in batch.column("shard").to_pylist():
                    for part in pq.ParquetFile(io.BytesIO(store.read(name))).iter_batches(2048):
                        yield pa.RecordBatch.from_arrays(part.columns, names)

        shards = self.entries(version).select("shard").repartition(max(1, min(version["shards"], 8192)))
        return map_rows(shards, run, self.schema)

    def vacuum(self, older: float = 86_400.0) -> int:
        """Deletes shards that the latest version doesn't name and that are older than so many seconds; call it when no reader uses an older version.

        Shards of an append or a compaction that hasn't committed yet are young: none may take longer than that.
        """
        store = Store(f"{self.folder}/shards")
        there = self.spark.createDataFrame([(n,) for n, age in store.ages() if age >= older], "shard string")
        live = self.entries(self.latest()).select("shard")
        dead = [r[0] for r in there.join(live, "shard", "left_anti").toLocalIterator()]
        for name in dead:
            store.remove(name)
        return len(dead)


def shard(rows: DataFrame, folder: str | None = None, **sizes: int) -> ShardStore:
    """A store that holds the rows as appended shards, compacted."""
    store = ShardStore(rows.sparkSession, folder or shared_path(rows.sparkSession, "shards"), rows.schema, **sizes)
    store.append(rows)
    store.compact()
    return store
