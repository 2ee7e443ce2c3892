"""Product codes of vectors: each vector is cut into equal parts, and each part is written as the index of its nearest codebook entry.

Codebooks are trained by Lloyd's rounds over all vectors, on integers: a component x counts as floor(`SCALE` * x), distances are
squared Euclidean, ties go to the lower index, and an entry becomes the componentwise floor of the mean of its parts (an
entry without parts stays). Every figure is an exact integer, so the result doesn't depend on partitions or their order.

Rounds use Yinyang's bounds. The entries of a codebook are clustered into `GROUPS` groups once; each part keeps, for each group, a
lower bound of its distance to the entries of that group but its own one. When entries have moved, a bound falls by the
largest drift in its group, and only groups whose bound is no longer above the exact distance to the part's own entry are scanned. A
scan is a matrix product in doubles; entries within the rounding error of the least distance are verified in integers.

What each round leaves (integer vectors, indexes, bounds as 16-bit numbers) is a table in the shared folder; tables that are no longer
read are removed. Sums and counts by entry are added up by Spark; the driver sees codebooks only (256 entries a part).

Edge cases: null vectors, and vectors with null or non-finite components, are dropped. The dimension is that of the vector with
the least id among those whose length is a positive multiple of the number of parts. Vectors of other lengths, or with a component too large for
exact 64-bit distances (about 3e5 at 64 dimensions), stay with a null code and a null error. Null ids come last. Repeated ids
and rows are rows of their own; of equal ids the lesser vector comes first in the initial codebook. Fewer vectors than `ENTRIES` give smaller codebooks, an empty table an empty
result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, named, stored, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Groups of entries in each codebook, and rounds of their clustering.
GROUPS, GROUP_ROUNDS = 16, 8
#: Bounds are whole numbers up to this; a lower one is still a bound.
MOST = 32767
#: Vectors that a task works on at once.
BLOCK = 4096


def largest(width: int) -> int:
    """Integer components below this keep squared distances of parts of this width within 64 bits, and their sums within those of 2^32 vectors."""
    return min(math.isqrt((2**63 - 1) // max(width, 1)) // 4, 2**30)


def clustered(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry: a few Lloyd's rounds over the entries themselves. Any grouping gives the same codes."""
    x = entries.astype(np.float64)
    means = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)]
    for _ in range(GROUP_ROUNDS):
        to = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([x[to == g].mean(0) if (to == g).any() else means[g] for g in range(len(means))])
    return np.unique(to, return_inverse=True)[1]


@dataclass
class Codebooks:
    """Entries by part, their groups, and how far each moved in the last update."""

    entries: list[np.ndarray]
    groups: list[np.ndarray]
    drift: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, first: np.ndarray, parts: int) -> Codebooks:
        entries = np.split(first, parts, axis=1)
        return cls(entries, [clustered(e, GROUPS) for e in entries])

    def updated(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """sums: by part and entry, the count and the componentwise sum."""
        new, drift = [e.copy() for e in self.entries], []
        for (part, entry), (n, total) in sums.items():
            new[part][entry] = [s // n for s in total]  # Python's integer division goes down
        for old, now in zip(self.entries, new, strict=True):
            moved = ((now - old) ** 2).sum(1)
            drift.append(np.array([math.isqrt(m - 1) + 1 if m else 0 for m in moved.tolist()], np.int64))
        return Codebooks(new, self.groups, drift)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def exact(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to as many entries, in 64-bit integers."""
    d = x - entries
    return np.einsum("ij,ij->i", d, d)


def root(d: np.ndarray) -> np.ndarray:
    """Whole numbers that aren't above the square roots, at most MOST."""
    r = np.minimum(np.sqrt(d.astype(np.float64)), MOST).astype(np.int64)
    return r - (r * r > d)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the nearest entry (lowest index of equals), its distance, and the distance to the nearest other one (a lower bound)."""
    f, e = x.astype(np.float64), entries.astype(np.float64)
    xx, ee = np.einsum("ij,ij->i", f, f), np.einsum("ij,ij->i", e, e)
    d = xx[:, None] - 2 * (f @ e.T) + ee
    slack = (4 * x.shape[1] + 16) * 2.0**-52 * (xx + ee.max())  # what doubles may be off; 0 would do for small numbers
    row = np.arange(len(x))
    best = d.argmin(1)
    close = d <= (d[row, best] + 2 * slack)[:, None]
    least = exact(x, entries[best])
    tied = np.flatnonzero(close.sum(1) > 1)  # ties, or too near to tell in doubles
    if len(tied):
        i, k = np.nonzero(close[tied])
        true = exact(x[tied[i]], entries[k])
        order = np.lexsort((k, true, i))
        first = order[np.append(True, np.diff(i[order]) > 0)]
        best[tied], least[tied] = k[first], true[first]
    if len(entries) == 1:
        return best, least, np.full(len(x), np.iinfo(np.int64).max)
    d[row, best] = np.inf
    return best, least, np.maximum(np.floor(d.min(1) - slack), 0).astype(np.int64)


def assign(x: np.ndarray, book: np.ndarray, groups: np.ndarray, drift: np.ndarray | None, code: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, bounds) of each row. Without a drift there are no bounds yet and all groups are scanned."""
    n, members = int(groups.max()) + 1, [np.flatnonzero(groups == g) for g in range(int(groups.max()) + 1)]
    if drift is None:
        code, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        bounds, scan = np.zeros((len(x), n), np.int64), np.ones((len(x), n), bool)
    else:
        fallen = np.array([drift[m].max() for m in members], np.int64)
        bounds = np.maximum(bounds.astype(np.int64) - fallen, 0)
        least = exact(x, book[code])
        scan = bounds * bounds <= least[:, None]  # an equal distance might be a tie
    code, old, before = code.copy(), code, least.copy()
    found = []
    for g, mine in enumerate(members):
        rows = np.flatnonzero(scan[:, g])
        if len(rows):
            k, d, other = nearest(x[rows], book[mine])
            k = mine[k]
            found.append((g, rows, k, d, other))
            better = (d < least[rows]) | (d == least[rows]) & (k < code[rows])
            code[rows[better]], least[rows[better]] = k[better], d[better]
    if drift is not None:  # an entry that is left counts in the bound of its group from now on
        left = np.flatnonzero(code != old)
        bounds[left, groups[old[left]]] = np.minimum(bounds[left, groups[old[left]]], root(before[left]))
    for g, rows, k, d, other in found:
        bounds[rows, g] = root(np.where(k == code[rows], other, d))
    return code, least, bounds


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def assigned(state: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """The state (row, v, and after the first round code and bounds) with code, error and bounds under these codebooks."""
    again, parts = bool(books.drift), len(books.entries)
    width = dim // parts
    spots = np.cumsum([0, *(int(g.max()) + 1 for g in books.groups)])
    schema = T.StructType([state.schema["row"], state.schema["v"], *(T.StructField(c, T.ArrayType(T.ShortType())) for c in ("code", "bounds")), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _matrix(batch.column("v"), dim)
                if again:
                    codes, bounds = _matrix(batch.column("code"), parts), _matrix(batch.column("bounds"), int(spots[-1]))
                out = []
                for p in range(parts):
                    was = (books.drift[p], codes[:, p], bounds[:, spots[p] : spots[p + 1]]) if again else (None, None, None)
                    out.append(assign(x[:, p * width : (p + 1) * width], books.entries[p], books.groups[p], *was))
                code, bound = np.stack([o[0] for o in out], 1).astype(np.int16), np.concatenate([o[2] for o in out], 1).astype(np.int16)
                error = sum(o[1] for o in out)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("v"), _lists(code), _lists(bound), pa.array(error)], ["row", "v", "code", "bounds", "error"])

    return state.select("row", "v", *(["code", "bounds"] if again else [])).mapInArrow(tidy(run), schema)


def sums(state: DataFrame, books: Codebooks, dim: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sum of the parts of each entry. Tasks send one row an entry, Spark adds them up."""
    parts, n = len(books.entries), len(books.entries[0])
    width = dim // parts
    columns = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            x, code = _matrix(batch.column("v"), dim), _matrix(batch.column("code"), parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(code[:, p], minlength=n)
        p, k = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(count[p, k]), *(pa.array(total[p, k, i]) for i in range(width))], ["part", "entry", "n", *columns])

    tasks = state.select("v", "code").mapInArrow(tidy(run), "part long, entry long, n long, " + ", ".join(f"{c} long" for c in columns))
    found = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect()
    return {(r["part"], r["entry"]): (r["n"], [r[c] for c in columns]) for r in found}


def finite(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))), F.lit(False))


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """The rows with a usable or at least finite vector, with code (indexes in part order) and error, and the codebooks (None where no vector is usable)."""
    x = named(vectors, vector)
    rows = vectors.filter(finite(x)).select(F.struct(*(named(vectors, c) for c in vectors.columns)).alias("row"), x.cast("array<double>").alias("x"), named(vectors, key).alias("key"))
    first = rows.filter((F.size("x") > 0) & (F.size("x") % parts == 0)).orderBy(F.col("key").asc_nulls_last(), "x").select(F.size("x").alias("dim")).limit(1).collect()
    if not first:
        return _back(rows.select("row", F.lit(None).cast("array<smallint>").alias("code"), F.lit(None).cast("long").alias("error")), vectors), None
    dim = first[0]["dim"]
    most = largest(dim // parts) / SCALE
    usable = (F.size("x") == dim) & F.forall("x", lambda c: F.abs(c) < F.lit(most))
    state = stored(rows.select("row", F.when(usable, F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))).alias("v"), "key"), "vectors")
    mine, rest = state.filter("v IS NOT NULL"), state.filter("v IS NULL")
    # at most ENTRIES rows come to the driver
    seeds = mine.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    if not seeds:
        return _back(rest.select("row", F.lit(None).cast("array<smallint>").alias("code"), F.lit(None).cast("long").alias("error")), vectors), None
    books, last = Codebooks.of(np.array([r["v"] for r in seeds], np.int64), parts), mine
    for _ in range(rounds):
        now = stored(assigned(last, books, dim), "codes")
        if last is not mine:
            dropped(last)
        last, books = now, books.updated(sums(now, books, dim))
    done = assigned(last, books, dim).select("row", "code", "error")
    none = rest.select("row", F.lit(None).cast("array<smallint>").alias("code"), F.lit(None).cast("long").alias("error"))
    return _back(done.unionByName(none), vectors), books


def _back(out: DataFrame, vectors: DataFrame) -> DataFrame:
    """The columns of the input and one struct of what was added, whose name no input column has."""
    return out.select(*(F.col("row")[c].alias(c) for c in vectors.columns), F.struct("code", "error").alias(added(vectors)))


def added(vectors: DataFrame) -> str:
    """The name of the struct of code and error: "coded", with as many underscores as it takes to clash with none."""
    name = "coded"
    while name in vectors.columns:
        name += "_"
    return name


def label_errors(coded: DataFrame, label: str, error: Column) -> DataFrame:
    """label, label_error: errors added up within tasks first; null is a label too."""
    return coded.groupBy(named(coded, label).alias("label")).agg(F.sum(error).alias("label_error"))
