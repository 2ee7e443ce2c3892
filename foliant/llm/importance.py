"""Importance resampling: draws documents whose n-grams look like those of a target.

Features are all runs of one to `ORDER` words, joined by one space; each counts in the bucket that its crc32 names. Pass one counts
buckets in tasks (np.bincount) and merges the vectors of `BUCKETS` numbers in a tree; the driver gets sums only. From corpus and target
each bucket has a gain, its smoothed log ratio in thousandths. Pass two gathers the gains, which are broadcast, and adds them up by
document (np.bincount with weights). A seeded Gumbel number by document makes the highest scores a draw without replacement.

crc32 is linear: a word's checksum is the exclusive or of what each byte gives at its distance from the end, and that of a run of words
follows from those of its words. So all features of a stretch of text come from a few array operations; no feature exists as a string.
Stretches are cut between words and carry the last words on, so very long texts take no more memory than others.

Edge cases: a null or empty text has no features, weight 0 and is never drawn (fewer than `least` words); a null id draws by the empty text
after the seed and comes last among equals; repeated rows are drawn one by one; an empty corpus or target leaves the smoothing alone; an empty table gives
an empty table. Other columns pass through; the result's own columns replace input columns of their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, named, ranked, tidy

BUCKETS, ORDER, SHARE, SEED, LEAST_WORDS = 10_000, 3, 5, 42, 20
#: Bytes of text that become features at once, about.
STRETCH = 1 << 18
#: Words of up to so many bytes are summed by tables, longer ones one by one.
SHORT = 48
_LOW = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Bytes of words: letters, digits and all beyond ASCII.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte with n zero bytes after it: the checksum without its constant; of a checksum's four bytes: what n zero bytes make of it."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    after = [one]
    for _ in range(SHORT):
        after.append(one[after[-1] & 255] ^ (after[-1] >> 8))
    shifts = [np.stack([np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)])]
    for _ in range(SHORT):
        shifts.append(one[shifts[-1] & 255] ^ (shifts[-1] >> 8))
    return np.stack(after), np.stack(shifts)


AFTER, SHIFT = _tables()
SPACE = AFTER[0][32]
#: By length: the checksum of zero bytes, the constant that was left out.
ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(ORDER * (SHORT + 1))], np.uint32)


def _shifted(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums without constant, followed by so many zero bytes."""
    out = np.empty_like(sums)
    short = by <= SHORT
    s, b = sums[short], by[short]
    out[short] = SHIFT[b, 0, s & 255] ^ SHIFT[b, 1, (s >> 8) & 255] ^ SHIFT[b, 2, (s >> 16) & 255] ^ SHIFT[b, 3, s >> 24]
    for i in np.flatnonzero(~short).tolist():
        x, left = int(sums[i]), int(by[i])
        # what a zero byte does is linear: x followed by n zeros is the checksum of n zeros begun at x, without that of n zeros begun at 0
        out[i] = zlib.crc32(bytes(left), x ^ 0xFFFFFFFF) ^ zlib.crc32(bytes(left), 0xFFFFFFFF)
    return out


def _constant(lengths: np.ndarray) -> np.ndarray:
    out = ZEROS[np.minimum(lengths, len(ZEROS) - 1)]
    for i in np.flatnonzero(lengths >= len(ZEROS)).tolist():
        out[i] = zlib.crc32(bytes(int(lengths[i])))
    return out


def buckets(data: np.ndarray, ends: np.ndarray, carried: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of the features of texts that lie one after another, by their number of words; ends: where each text ends.

    The first `carried` words were seen before: only features that end after them count.
    """
    low, word = _LOW[data], _WORD[data]
    begin, end = word.copy(), word.copy()
    heads = np.append(0, ends[:-1])
    heads = heads[heads < len(data)]
    begin[1:] &= ~word[:-1]
    begin[heads] = word[heads]
    end[:-1] &= ~word[1:]
    last = ends[ends > 0] - 1
    end[last] = word[last]
    first, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(first):
        return
    size, text = stop - first, np.searchsorted(ends, first, "right")
    at = np.flatnonzero(word)
    of = np.repeat(np.arange(len(first)), size)
    sums = np.bitwise_xor.reduceat(AFTER[np.minimum(stop[of] - 1 - at, SHORT), low[at]], np.append(0, np.cumsum(size)[:-1]))
    for i in np.flatnonzero(size > SHORT).tolist():
        sums[i] = zlib.crc32(low[first[i] : stop[i]].tobytes()) ^ zlib.crc32(bytes(int(size[i])))
    run, length = sums, size
    yield (run[carried:] ^ _constant(length[carried:])) % BUCKETS, text[carried:]
    for n in range(2, ORDER + 1):
        if len(first) < n:
            return
        left = SHIFT[1, 0, run[:-1] & 255] ^ SHIFT[1, 1, (run[:-1] >> 8) & 255] ^ SHIFT[1, 2, (run[:-1] >> 16) & 255] ^ SHIFT[1, 3, run[:-1] >> 24] ^ SPACE
        run, length = _shifted(left, size[n - 1 :]) ^ sums[n - 1 :], length[:-1] + 1 + size[n - 1 :]
        whole = text[n - 1 :] == text[: 1 - n]
        whole[: max(0, carried - n + 1)] = False
        yield (run[whole] ^ _constant(length[whole])) % BUCKETS, text[n - 1 :][whole]


def stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, ends of texts, first text, carried words): whole texts together, or a part of a long one with the words before it."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STRETCH, "right")) - 1)
        at, end = int(offsets[i]), int(offsets[j])
        if j > i + 1 or end - at <= STRETCH:
            yield data[at:end], offsets[i + 1 : j + 1] - at, i, 0
        else:
            kept: list[bytes] = []
            while at < end:
                cut = at + STRETCH
                while cut < end and _WORD[data[cut]] and _WORD[data[cut - 1]]:  # not inside a word
                    gap = np.flatnonzero(~_WORD[data[cut : cut + STRETCH]])
                    cut = min(end, cut + (int(gap[0]) if len(gap) else STRETCH))
                cut = min(cut, end)
                piece = b" ".join([*kept, data[at:cut].tobytes()])
                yield np.frombuffer(piece, np.uint8), np.array([len(piece)]), i, len(kept)
                kept, at = _last_words(piece), cut
        i = j


def _last_words(piece: bytes) -> list[bytes]:
    """The last ORDER - 1 words of a piece."""
    word = _WORD[np.frombuffer(piece, np.uint8)]
    out: list[bytes] = []
    stop = len(piece)
    while len(out) < ORDER - 1:
        there = _last(word, stop, True)
        if there < 0:
            break
        before = _last(word, there, False)
        out.insert(0, piece[before + 1 : there + 1])
        stop = before + 1
    return out


def _last(flags: np.ndarray, stop: int, value: bool) -> int:
    """The last place before stop with this flag, or -1; looks back a little at a time."""
    while stop > 0:
        start = max(0, stop - 4096)
        found = np.flatnonzero(flags[start:stop] == value)
        if len(found):
            return start + int(found[-1])
        stop = start
    return -1


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data, ends, _, carried in stretches(batch.column(0)):
                for found, _ in buckets(data, ends, carried):
                    total += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(named(texts, text).alias("c0")).mapInArrow(tidy(run), "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(BUCKETS, np.int64)
    depth = max(2, math.ceil(math.log(parts, 64)))
    return vectors.treeReduce(np.add, depth)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln of the ratio of its smoothed shares in target and corpus)."""
    whole, wanted = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (whole + BUCKETS) / ((s + 1.0) * (wanted + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> DataFrame:
    """Adds n_words, n_features and weight."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text), bucket_counts(target, target_text)))  # BUCKETS numbers
    new = ["n_words", "n_features", "weight"]
    keep = [c for c in docs.columns if c not in new]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType(), False) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for data, ends, first, carried in stretches(batch.column(text)):
                mine = slice(first, first + len(ends))
                for k, (found, of) in enumerate(buckets(data, ends, carried)):
                    n = np.bincount(of, minlength=len(ends))
                    out[0, mine] += n if not k else 0
                    out[1, mine] += n
                    out[2, mine] += np.bincount(of, gain.value[found], len(ends)).astype(np.int64)  # exact: whole numbers far below 2^53
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, out)], [*keep, *new])

    return map_rows(docs, run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A seeded number of each id: floor(-1000 ln(-ln u)), u from the first 32 bits of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, key: str = "doc_id", share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Adds score and rank: of the rows with enough words, share percent get a rank (1, 2, 3, ...), the highest scores first, ties by lesser id.

    Ranks come from a sort by ranges; pass narrow rows (id, n_words, weight), not texts.
    """
    keep = [named(weighed, c) for c in weighed.columns if c not in ("score", "rank")]
    able = F.col("n_words") >= least
    rows = weighed.select(*keep, (F.col("weight") + gumbel(named(weighed, key), seed)).alias("score"))
    drawn = share * weighed.filter(able).count() // 100
    placed = ranked(rows, able.desc(), F.desc("score"), named(rows, key).asc_nulls_last(), "weight", kind="long")
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
