"""Exact Jaccard join of word n-gram sets by pigeonhole over partitions of the universe.

Sets are bands of sizes. In a band, a hash deals the n-grams of the universe into m segments. Two sets with
Jaccard similarity 0.8 differ in D <= (|x| + |y|) / 9 n-grams, so if m is large enough, some segment is the same in
both. Small sets use fewer segments and index, beside each segment, all its one-deletion neighbours: a segment of two n-grams or
more then serves for one difference more (one of a single n-gram doesn't: the other set may have it empty, and empty segments
tell nothing). `plan` picks m for each band as the cheapest allocation whose usable segments
exceed D with a margin. A set whose usable segments don't is dealt anew by another hash, and again, until they do; it indexes
every level up to that one, so it meets its partners at the level of whichever of both stops first. A set meets
the band of its size and, where a larger partner may lie there, the next one.

What breaks the pigeonhole are *hot* segments, whose signature more than `HOT` sets share (passages that many documents contain,
large groups of near copies). Sets in small groups are paired at once. A set that can spare its hot segments finds all
its partners in the others, and one of both sets is enough. Sets that cannot (`deficient`) and link share at least as many hot
segments as one of them lacks, so each needs only its rarest ones (a prefix in one order of all signatures). Of each such group, two
hubs are compared with all members; members that are then still apart from the first hub's component are compared with the
whole group, in blocks of bounded size.

Candidates pass a bound first: parities of n-grams dealt into bits differ in at most D places, so a pair with more
differing bits is no link. The rest is verified on the sets of whole texts. Identical sets are one node throughout (a 64-bit
key of the set), so copies are never expanded. N-grams are compared by 64-bit hashes.

Edge cases: null and wordless texts have the empty set and link with nothing; texts of fewer than n
words are one n-gram; rows with one doc_id but different texts are separate nodes, each gets its own row;
null ids are kept and never name a component that has an id; repeated rows give repeated rows; empty tables
give empty tables; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, stored, tidy
from .hashed import MIX, mix, words

N, HOT, BLOCK, LEVELS = 5, 16, 1024, 6
#: Sets below this size index one-deletion neighbours.
SMALL_SET = 64
#: Node keys that may be broadcast (8 bytes each), and links (16 bytes each) that one task joins into components at a time.
SMALL, PART = 1_000_000, 1_000_000
GROWTH = 1.6
#: N-gram hashes behind a bucket of signatures, about.
BUCKET = 1_000_000
#: In the low bits of a signature: the segment, the band, the level. This segment is of sets that no level serves.
_AT, _BAND, _LEVEL, _REST = 12, 6, 3, 0xFFF


def _sets(h: np.ndarray, count: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of texts from the hashes of their words and the number of each."""
    grams = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        grams = mix(grams * MIX + h[i : len(h) - n + 1 + i])
    a = 0
    for c in count.tolist():
        if c >= n:
            s = np.sort(grams[a : a + c - n + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        else:
            g = np.full(min(c, 1), c, np.uint64)
            for i in range(c):
                g = mix(g * MIX + h[a + i : a + i + 1])
            yield g
        a += c


def sets_of(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """Of each text of an Arrow column: the sorted distinct hashes of its n-grams of words, A-Z lower-cased."""
    for h, count in words(column):
        yield from _sets(h, count, n)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    return next(sets_of(pa.array([text], pa.string()), n))


def key_of(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set dealt into bits; as many bits as the power of two over twice its size."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    ones = np.bincount((mix(s + np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) as they would be with fewer bits: halves add up as parities."""
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference."""
    width = min(len(x), len(y))
    a, b = (folded(np.frombuffer(s, np.uint8)[None], width) for s in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    return 5 * min(n, m) >= 4 * max(n, m) and 9 * least_difference(x, y) <= n + m


@lru_cache(maxsize=1)
def edges_of_bands() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * GROWTH)))
    return np.array(out, np.int64)


@lru_cache(maxsize=None)
def plan(band: int) -> tuple[int, bool]:
    """(segments, one-deletion neighbours or not) of a band: the least m whose expected usable segments clear the differences by 4 deviations."""
    low, top = int(edges_of_bands()[band]), int(edges_of_bands()[band + 1]) - 1
    near = top < SMALL_SET
    if near:
        return (1 if 2 * top // 9 <= 1 else max(3, top // 4)), True
    sizes = np.unique(np.linspace(max(1, low * 4 // 5), top, 8).astype(int))
    m = 2 * top // 9 + 1
    while True:
        load = sizes / m
        empty = m * np.exp(-load)
        spread = np.sqrt(empty * (1 - (1 + load) * np.exp(-load)))
        if np.all(m - empty - 4 * spread - 1 > (sizes + np.minimum(top, sizes * 5 // 4)) // 9):
            return m, False
        m += max(1, m // 40)


def signatures(s: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(band, level, slack, signatures of all levels up to that one) for each band the set meets.

    Slack: usable segments of the level beyond those that differences may take and one. Sets that may only link with identical ones need none.
    """
    n, bands, out = len(s), edges_of_bands(), []
    own = int(np.searchsorted(bands, n, "right")) - 1
    for band in (own, own + 1):
        if band > own and n * 5 // 4 < bands[band]:
            break
        d = (n + min(int(bands[band + 1]) - 1, n * 5 // 4)) // 9
        if not d:
            continue
        (m, near), sigs = plan(band), []
        for level in range(LEVELS):
            place = (mix(s ^ np.uint64(0xD1B54A32D192ED03 + level)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, tokens = place[order], mix(s[order] + np.uint64(band + 1))
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            sizes = np.diff(np.append(starts, n))
            whole = np.add.reduceat(tokens, starts)  # a sum mod 2^64 doesn't depend on order, and deletion subtracts
            at, sig = place[starts], whole
            if near:
                several = np.repeat(sizes > 1, sizes)
                sig = np.concatenate([whole, (np.repeat(whole, sizes) - tokens)[several]])
                at = np.concatenate([at, place[several]])
            slack = int((sizes > 1).sum()) - d // 2 - 1 if near else len(starts) - d - 1
            sigs.append(mix(sig + at.astype(np.uint64)) & ~np.uint64((1 << (_AT + _BAND + _LEVEL)) - 1) | np.uint64(level << (_AT + _BAND) | band << _AT) | (at & 0xFFF).astype(np.uint64))
            if slack >= 0:
                break
        else:
            sigs.append(np.array([LEVELS << (_AT + _BAND) | band << _AT | _REST], np.uint64))  # the group of sets that no level serves
        out.append((band, level, slack, np.concatenate(sigs)))
    return out


def nodes(docs: DataFrame, text: str, doc: str) -> DataFrame:
    """doc, n, key and sketch of every row, with band, level and slack of what it indexes, and the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, bits, slack = [], [], [], []
            for s in sets_of(batch.column("text")):
                n.append(len(s))
                key.append(key_of(s) if len(s) else None)
                bits.append(sketch(s) if len(s) else None)
                slack.append([band << 40 | level << 36 | more + (1 << 30) for band, level, more, _ in signatures(s)] if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("same"), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(bits, pa.binary()), pa.array(slack, pa.list_(pa.int64()))], ["doc", "same", "n", "key", "bits", "slack"])

    rows = docs.select(named(docs, doc).alias("doc"), named(docs, text).alias("text")).withColumn("same", F.xxhash64("text"))
    return rows.mapInArrow(tidy(run), f"doc {rows.schema['doc'].dataType.simpleString()}, same long, n long, key long, bits binary, slack array<long>")


def groups(docs: DataFrame, text: str, n_grams: int) -> DataFrame:
    """Rows (a, b): pairs of nodes in small groups (sig null); and (a, sig, size): members of hot signatures (b null).

    Entries travel as packed numbers: a row for each bucket and batch, copies already merged.
    """
    buckets = int(min(1 << 16, max(64, n_grams // BUCKET)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs, keys = [], []
            for s in sets_of(batch.column("text")):
                if len(s) and (k := key_of(s)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(k)
                    for _, _, _, sig in signatures(s):
                        sigs.append(sig)
                        keys.append(np.full(len(sig), k, np.int64))
            if not sigs:
                continue
            sig, key = np.concatenate(sigs), np.concatenate(keys)
            b = ((sig >> np.uint64(_AT + _BAND + _LEVEL)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            sig, key, b = sig[order], key[order], b[order]
            cuts = np.flatnonzero(np.diff(b, prepend=-1))
            ends = np.append(cuts[1:], len(b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[cuts], pa.int64()), pa.array([sig[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary()), pa.array([key[x:y].tobytes() for x, y in zip(cuts, ends, strict=True)], pa.binary())],
                ["bucket", "sigs", "keys"],
            )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for b, s, k in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "keys")), strict=True):
                by.setdefault(b, []).append((s, k))
        for parts in by.values():
            sig = np.concatenate([np.frombuffer(s, np.uint64) for s, _ in parts])
            key = np.concatenate([np.frombuffer(k, np.int64) for _, k in parts])
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            first = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))
            sig, key = sig[first], key[first]
            starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            sizes = np.diff(np.append(starts, len(sig)))
            a, b = [], []
            for size in range(2, HOT + 1):
                g = starts[sizes == size]
                for i in range(size):
                    for j in range(i + 1, size):
                        a.append(key[g + i])
                        b.append(key[g + j])
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                nothing = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), nothing, nothing], ["a", "b", "sig", "size"])
            size = np.repeat(sizes, sizes)
            if (hot := size > HOT).any():
                yield pa.RecordBatch.from_arrays([pa.array(key[hot]), pa.nulls(int(hot.sum()), pa.int64()), pa.array(sig[hot].view(np.int64)), pa.array(size[hot])], ["a", "b", "sig", "size"])

    packed = docs.select(named(docs, text).alias("text")).mapInArrow(tidy(pack), "bucket long, sigs binary, keys binary")
    return packed.repartition(buckets, "bucket").mapInArrow(tidy(pair), "a long, b long, sig long, size long")


def deficient(hot: DataFrame, known: DataFrame) -> DataFrame:
    """(key, sig): of each set that can't spare the hot segments it has in a band, those that its partners may meet it by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sigs = [], []
            for key, met, slack in zip(*(batch.column(c).to_pylist() for c in ("key", "met", "slack")), strict=True):
                sig = np.array([m["sig"] for m in met], np.int64)
                sig = sig[np.lexsort((sig, [m["size"] for m in met]))]  # rarest first, one order for all sets
                at, band, level = sig & 0xFFF, sig >> _AT & 0x3F, sig >> (_AT + _BAND) & 7
                for x in slack:
                    own, served, more = x >> 40, x >> 36 & 0xF, (x & 0xFFFFFFFF) - (1 << 30)
                    mine = band == own
                    here = mine & (level == served)
                    near = plan(own)[1]
                    many = len(np.unique(at[here])) if near else int(here.sum())
                    if more < 0 or many <= more:
                        if more >= 0 or not mine.any():
                            continue
                    elif not near:
                        here &= np.cumsum(here) <= many - more
                        mine = here | mine & (level != served)
                    sigs.append(sig[mine])
                    keys.append(np.full(int(mine.sum()), key, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sigs))], ["key", "sig"])

    met = hot.groupBy("key").agg(F.collect_list(F.struct("sig", "size")).alias("met"))  # as many as the set has segments, at most
    return met.join(known.select("key", "slack"), "key").mapInArrow(tidy(run), "key long, sig long")


def near_enough(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes those that sizes and parities don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            keep = pa.array([may_link(*q) for q in zip(n, m, x, y, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    left = known.select(F.col("key").alias("a"), "n", F.col("bits").alias("x"))
    right = known.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").filter("5 * least(n, m) >= 4 * greatest(n, m)").mapInArrow(tidy(run), "a long, b long")


def linked(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Verifies pairs (a, b) of nodes on the sets of whole texts: 100 * |x & y| >= 80 * |x | y|."""
    pairs = stored(pairs, "pairs")
    need = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "needed")
    few = need.limit(SMALL + 1).count() <= SMALL

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, bytes] = {}
            for s in sets_of(batch.column("text")):
                if len(s):
                    found.setdefault(key_of(s), s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["key", "s"])

    every = docs.select(named(docs, text).alias("text")).mapInArrow(tidy(own), "key long, s binary")
    sets = stored(every.join(F.broadcast(need) if few else need, "key").groupBy("key").agg(F.min("s").alias("s")), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("key").alias("a"), F.col("s").alias("x")), sets.select(F.col("key").alias("b"), F.col("s").alias("y"))
    return stored(pairs.join(left, "a").join(right, "b").mapInArrow(tidy(run), "a long, b long"), "links")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the components among the links of one task, `PART` links at a time: (a, b) with b the least."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        to = np.arange(len(keys))
        while True:  # hook the greater root to the lesser, then shorten all ways
            low, high = np.minimum(to[x], to[y]), np.maximum(to[x], to[y])
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(to, high[apart], low[apart])
            while (to[to] != to).any():
                to = to[to]
        leaf = np.flatnonzero(to != np.arange(len(keys)))
        return pa.RecordBatch.from_arrays([pa.array(keys[leaf]), pa.array(keys[to[leaf]])], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b")])
        size += len(batch)
        if size >= PART:
            yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))


def components(links: DataFrame) -> DataFrame:
    """(key, root) of all linked nodes: stars within tasks, then alternating large and small stars between them.

    Only minima are gathered, never neighbour lists. Links that fit one part need no rounds.
    """
    e = links.select("a", "b")
    while True:
        n = e.count()
        parts = -(-n // PART)
        if not n:
            return e.select(F.col("a").alias("key"), F.col("b").alias("root"))
        e = stored(e.coalesce(parts).mapInArrow(tidy(joined), "a long, b long"), "stars")
        if parts > 1:
            # where every node has one edge and no root has any, the stars are the components
            several = e.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("a").alias("x"))
            chained = e.select(F.col("b").alias("x")).distinct().join(e.select(F.col("a").alias("x")), "x", "left_semi")
            if several.unionByName(chained).limit(1).count():
                both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
                low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
                large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                large = stored(large.distinct(), "stars")
                low = large.groupBy("a").agg(F.min("b").alias("m"))
                small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
                e = stored(small.filter("a <> b").distinct(), "stars")
                continue
        return e.select(F.col("a").alias("key"), F.col("b").alias("root"))


def join(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row for each input row: doc, n (size of its set), component (least id reachable by links), same (hash of the text) and
    cluster (the same for all rows of a component, whatever their ids; null for empty sets)."""
    rows = stored(nodes(docs, text, doc), "nodes")
    known = stored(rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("slack").alias("slack")), "known")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = stored(groups(docs, text, total), "groups")
    hot = stored(deficient(found.filter("sig IS NOT NULL").select(F.col("a").alias("key"), "sig", "size"), known), "deficient")
    hubs = hot.groupBy("sig").agg(F.count("*").alias("c"), F.min_by("key", _order(0)).alias("h"), F.min_by("key", _order(1)).alias("i")).filter("c > 1")
    stars = hot.join(hubs, "sig").select("key", F.explode(F.array("h", "i")).alias("hub")).filter("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
    pairs = found.filter("sig IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(stars).distinct()
    root = stored(components(linked(near_enough(pairs, known), docs, text)), "roots")

    now = stored(hot.join(root, "key", "left").select("key", "sig", F.coalesce("root", "key").alias("root")), "rooted")
    # the first hub's component is the main one of its group
    apart = stored(now.groupBy("sig").agg(F.min("root").alias("r"), F.max("root").alias("t"), F.min_by("root", _order(0)).alias("main")).filter("r <> t").select("sig", "main"), "apart")
    if apart.limit(1).count():
        more = linked(near_enough(blocks(now, apart, known), known), docs, text)
        root = stored(components(more.unionByName(root.select(F.col("key").alias("a"), F.col("root").alias("b")))), "roots")

    # a component's id is the least id of its nodes
    reached = root.unionByName(root.select(F.col("root").alias("key"), "root").distinct())
    ids = reached.join(known.select("key", "doc"), "key")
    least = ids.groupBy("root").agg(F.min("doc").alias("component"))
    ids = reached.join(least, "root").select("key", "component", "root")
    of = known.select("key", F.col("doc").alias("least")).join(ids, "key", "left").select("key", F.coalesce("component", "least").alias("component"), F.coalesce("root", "key").alias("cluster"))
    return rows.select("doc", "same", "n", "key").join(of, "key", "left").select("doc", "n", F.coalesce("component", "doc").alias("component"), "same", "cluster")


def _order(k: int):
    return F.xxhash64("key", F.lit(k))


def blocks(members: DataFrame, apart: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of different components in one group: what isn't of the main component against the whole group, by parities, in blocks of bounded size."""
    rows = members.join(apart, "sig")
    sizes = rows.groupBy("sig").agg(F.floor(F.count("*") / BLOCK).alias("last"), F.floor(F.count_if(F.col("root") != F.col("main")) / BLOCK).alias("last_minor"))
    rows = rows.join(sizes, "sig").select("key", "sig", "root", (F.col("root") != F.col("main")).alias("minor"), "last", "last_minor")
    # by key again before rows multiply: a hot group must not be dealt out by one task
    rows = rows.join(known.select("key", "n", "bits"), "key")
    mine = F.pmod(F.xxhash64("key"), F.col("last") + 1)
    first = rows.filter("minor").select("sig", F.pmod(F.xxhash64("key"), F.col("last_minor") + 1).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("j"), F.lit(True).alias("side"), "key", "root", "n", "bits")
    second = rows.select("sig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_minor"))).alias("i"), mine.alias("j"), F.lit(False).alias("side"), "key", "root", "n", "bits")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        key, root, n = (table.column(c).to_numpy() for c in ("key", "root", "n"))
        bits = table.column("bits").to_pylist()
        width = np.array([len(b) for b in bits])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        of = lambda where: np.frombuffer(b"".join([bits[k] for k in where.tolist()]), np.uint8).reshape(len(where), -1)
        for w in np.unique(width[side]).tolist():
            left = np.flatnonzero(side & (width == w))
            for v in np.unique(width[~side]).tolist():
                right = np.flatnonzero(~side & (width == v))
                x, y = (folded(of(where), min(w, v)).view(np.uint64) for where in (left, right))
                for k, i in enumerate(left.tolist()):
                    total = n[i] + n[right]
                    may = (root[right] != root[i]) & (5 * np.minimum(n[i], n[right]) >= 4 * np.maximum(n[i], n[right]))
                    may &= 9 * np.bitwise_count(x[k] ^ y).sum(1, dtype=np.int64) <= total
                    other = key[right[may]]
                    a.append(np.minimum(key[i], other))
                    b.append(np.maximum(key[i], other))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return first.unionByName(second).groupBy("sig", "i", "j").applyInArrow(run, "a long, b long").distinct()
