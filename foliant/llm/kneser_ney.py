"""Interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped by workers.

A text is its words (A-Z lower-cased) and one end token, after start tokens that are context only. The lower orders
have the continuation counts of the method (distinct words before an n-gram). Counts of counts give three discounts for each order (Chen
and Goodman), and the lowest order interpolates with the
uniform distribution over the known words and one unknown, so every text has a finite probability.

Words are counted first and numbered, frequent ones first (by powers of two of their counts). Each batch then adds up its own n-grams
and sends blocks to slices of the hash space: sorted columns of word numbers, byte by byte and compressed, some 5 bytes a trigram in
place of 28. Trigrams are dealt by
their first two words, so what they tell of these as a context is whole in one slice: it goes to a file, while the last two words go on
to slices of pairs, and what pairs tell of words to slices of words. Slices grow in number with the corpus, not in size. The driver
gets a few sums of each slice.

A slice is a file of sorted hash arrays: the leading bits of a key are its place in a table of offsets, the next 32 bits are stored, so a
foreign n-gram passes for a known one once in some hundred million lookups. Words have their whole 64 bits. Of n-grams counted once
only the key is stored, and a context met once needs no entry at all: the pair is known, so it has one continuation.

Workers memory-map these files, so of a model of any size a worker
holds the pages that it touches. Where the shared folder is no mounted path, a worker reads slices into memory and keeps a few.

Edge cases: null and empty texts are the end token alone; with no training text every token has the uniform probability of
the one unknown word; a null doc_id is not held out, for its fold is null; repeated rows give repeated rows; an
empty table gives an empty table; other columns pass through, and the new ones replace input columns of the same names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, named, shared_path, stored, tidy
from .files import Store
from .hashed import MIX, mix
from .hashed import words as hashed_words

FOLDS, HELD_OUT, ORDER = 7, 2, 3
#: Tokens behind a slice of n-grams, behind one of words, and in a chunk that is added up or scored at once, about.
SLICE, WORDS, CHUNK = 4_000_000, 40_000_000, 2_000_000
#: Tokens of a part of a text whose words don't fit side by side: with their contexts fewer than 2^21 different ones.
PIECE = 1 << 19
END = np.uint64(1)  # hash of the token that isn't a word
#: Slices that a worker keeps in memory where it can't map them.
KEPT = 16


def pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context * MIX) + word)


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For stretches of the column: all tokens, the end of each text included, and how many each text has."""
    for h, count in hashed_words(column):
        h[h <= END] += np.uint64(2)
        yield np.insert(h, np.cumsum(count), END), count + 1


def before(v: np.ndarray, sizes: np.ndarray, first) -> np.ndarray:
    """What stands before each of v (any array along the tokens), with `first` at the start of every text."""
    out = np.empty_like(v)
    out[1:] = v[:-1]
    out[np.append(0, np.cumsum(sizes)[:-1])] = first
    return out


# --- blocks ---


def _planes(a: np.ndarray) -> list[bytes]:
    """Numbers byte by byte, all lowest bytes first: high bytes of small numbers then compress to nothing. Led by their width."""
    kind = np.uint32 if not len(a) or int(a.max()) < 1 << 32 else np.uint64
    width = np.dtype(kind).itemsize
    return [bytes([width]), a.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()]


def dump(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, the first in order, as one block."""
    import zstandard

    parts = [np.array([len(columns), len(columns[0])], np.uint64).tobytes(), *_planes(np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0)))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*parts, *(p for c in columns[1:] for p in _planes(c))]))


def load(block: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(block)
    columns, n = np.frombuffer(data, np.uint64, 2).tolist()
    at, out = 16, []
    for _ in range(columns):
        width = data[at]
        kind = np.uint32 if width == 4 else np.uint64
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T).view(kind).ravel())
        at += 1 + width * n
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def loaded(blocks: list[bytes], columns: int) -> list[np.ndarray]:
    """The rows of several blocks as columns of 64-bit numbers."""
    parts = [load(b) for b in blocks if b]
    return [np.concatenate([p[k].astype(np.uint64) for p in parts]) if parts else np.empty(0, np.uint64) for k in range(columns)]


def dealt(slot: np.ndarray, columns: list[np.ndarray], first: int = 0) -> pa.RecordBatch:
    """Rows (slot, data): a block for each slot that rows are dealt to. Rows keep their order."""
    parts = _stretches(slot)
    return _rows([int(slot[p[0]]) + first for p in parts], [dump([c[p] for c in columns]) for p in parts])


def _stretches(slot: np.ndarray) -> list[np.ndarray]:
    """The places of each slot, in order."""
    order = np.argsort(slot, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []


def summed(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first row of each, and its summed counts."""
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[starts], order[starts], np.add.reduceat(counts[order], starts) if len(key) else counts


def _rows(slots, blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(blocks, pa.binary())], ["slot", "data"])


def _by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    parts: dict[int, list[bytes]] = {}
    for batch in batches:
        for slot, data in zip(batch.column("slot").to_pylist(), batch.column("data").to_pylist(), strict=True):
            parts.setdefault(slot, []).append(data)
    for slot in sorted(parts):
        yield slot, parts.pop(slot)


# --- files of sorted keys ---


def _sorted_keys(g: np.ndarray) -> bytes:
    """Keys in order: their number, the bits of the offset table, that table, and of each key the 32 bits that follow."""
    bits = int(max(0, min(24, (len(g) // 6).bit_length())))
    top = (g >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g), np.int64)
    offsets = np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.uint32)
    rest = (g >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    body = np.concatenate([offsets, rest])
    return np.array([len(g), bits], np.uint64).tobytes() + body.tobytes() + b"\0" * (4 * (len(body) % 2))


def _gram_file(g: np.ndarray, facts: list[np.ndarray]) -> bytes:
    """Sorted keys whose first fact is 1 and tells the rest, then those whose facts fit a byte each, then the others with 64 bits a fact."""
    once = facts[0] == 1
    small = np.all([f < 256 for f in facts], 0) & ~once
    out = [_sorted_keys(g[once])]
    for mine, kind in ((small, np.uint8), (~small & ~once, np.uint64)):
        body = b"".join(f[mine].astype(kind).tobytes() for f in facts)
        out += [_sorted_keys(g[mine]), body, b"\0" * (-len(body) % 8)]
    return b"".join(out)


class Slice:
    """A file of `_gram_file` in one worker."""

    def __init__(self, data: np.ndarray, facts: int = 1):
        self.once, at = self._keys(data, 0)
        self.more = []
        for kind in (np.uint8, np.uint64):
            keys, at = self._keys(data, at)
            n = len(keys[2])
            size = -(-n * facts * np.dtype(kind).itemsize // 8)
            self.more.append((keys, data[at : at + size].view(kind)[: n * facts].reshape(facts, n)))
            at += size

    @staticmethod
    def _keys(data: np.ndarray, at: int) -> tuple[tuple[int, np.ndarray, np.ndarray], int]:
        n, bits = int(data[at]), int(data[at + 1])
        size = (1 << bits) + 1 + n
        body = data[at + 2 : at + 2 + -(-size // 2)].view(np.uint32)
        return (bits, body[: (1 << bits) + 1], body[(1 << bits) + 1 : size]), at + 2 + -(-size // 2)

    @staticmethod
    def _find(keys: tuple[int, np.ndarray, np.ndarray], g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of g among the keys, and which of them are there."""
        bits, offsets, rest = keys
        if not len(rest):
            return np.zeros(len(g), np.int64), np.zeros(len(g), bool)
        top = (g >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g), np.int64)
        want = (g >> np.uint64(32 - bits) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low, high = offsets[top].astype(np.int64), offsets[top + 1].astype(np.int64)
        end = high
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            less = (rest[np.minimum(mid, len(rest) - 1)] < want) & (mid < high)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        inside = np.minimum(low, len(rest) - 1)
        return inside, (low < end) & (rest[inside] == want)

    def facts(self, g: np.ndarray, out: np.ndarray) -> None:
        """Fills in the rows of facts of keys that are there. What was counted once has, as a context, one continuation of count 1."""
        there = self._find(self.once, g)[1]
        out[:2, there] = 1
        left = np.flatnonzero(~there)
        for keys, facts in self.more:
            at, there = self._find(keys, g[left])
            out[:, left[there]] = facts[:, at[there]]
            left = left[~there]


@dataclass
class Vocabulary:
    """Words in slices by hash: sorted keys, their counts, and their places among the words of like counts."""

    folder: str
    slices: int
    tokens: int
    types: int

    def open(self) -> Words:
        return Words(self)


class Words:
    """A vocabulary in one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.store = vocabulary, Store(vocabulary.folder)
        self.files: dict[int, list[np.ndarray]] = {}
        self.offsets = self.store.mapped("offsets").reshape(vocabulary.slices, 64)

    def slice(self, k: int) -> list[np.ndarray]:
        if k not in self.files:
            if self.store.path is None and len(self.files) >= KEPT:
                self.files.clear()
            data = self.store.mapped(f"vocabulary-{k}")
            n = int(data[0])
            half = -(-n // 2)
            self.files[k] = [data[1 : 1 + n], data[1 + n : 1 + 2 * n], data[1 + 2 * n : 1 + 2 * n + half].view(np.uint32)[:n]]
        return self.files[k]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of word hashes; an unknown word has the number after the start's, and no count."""
        number, count = np.full(len(h), self.v.types + 1, np.uint64), np.zeros(len(h), np.int64)
        slot = (h % np.uint64(self.v.slices)).astype(np.int64)
        for k in np.unique(slot).tolist():
            keys, counts, ranks = self.slice(k)
            mine = np.flatnonzero(slot == k)
            at, there = _place(keys, h[mine])
            mine, at = mine[there], at[there]
            count[mine] = counts[at]
            number[mine] = self.offsets[k][_class(counts[at])] + ranks[at]
        return number, count


def _class(counts: np.ndarray) -> np.ndarray:
    """0 for the greatest counts, 63 for single ones."""
    return 63 - np.frexp(counts.astype(np.float64))[1].astype(np.int64) + 1


def vocabulary(texts: DataFrame, size: int) -> Vocabulary:
    """Counts and numbers the words of all texts (column text; size: characters, about)."""
    spark = texts.sparkSession
    folder, slices = shared_path(spark, "vocabulary"), int(max(1, size // (6 * WORDS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, _ in chunks(batches):
            h, n = np.unique(v, return_counts=True)
            yield dealt((h % np.uint64(slices)).astype(np.int64), [h, n])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for slot, blocks in _by_slot(batches):
            h, n = loaded(blocks, 2)
            h, _, n = summed(h, n)
            kind = _class(n)
            order = np.argsort(kind, kind="stable")
            sizes = np.bincount(kind, minlength=64)
            ranks = np.empty(len(h), np.uint32)
            ranks[order] = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            store.write(f"vocabulary-{slot}", np.array([len(h)], np.uint64).tobytes() + h.tobytes() + n.astype(np.uint64).tobytes() + ranks.tobytes() + b"\0" * (4 * (len(h) % 2)))
            yield _rows([slot], [np.append(sizes, n.sum()).astype(np.int64).tobytes()])

    rows = texts.mapInArrow(tidy(count), "slot long, data binary")
    told = stored(sliced(rows, 0, slices, write), "vocabulary-sums").collect()  # 65 numbers a slice
    sums = np.zeros((slices, 65), np.int64)
    for r in told:
        sums[r["slot"]] = np.frombuffer(r["data"], np.int64)
    flat = sums[:, :64].T.ravel()  # by class, then slice
    offsets = (np.cumsum(flat) - flat).reshape(64, slices).T
    Store(folder).write("offsets", np.ascontiguousarray(offsets).astype(np.uint64).tobytes())
    return Vocabulary(folder, slices, int(sums[:, 64].sum()), int(flat.sum()))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes and the sizes of texts, about `CHUNK` tokens at a time."""
    held, lengths, n = [], [], 0
    for batch in batches:
        for v, sizes in tokens(batch.column("text")):
            held.append(v)
            lengths.append(sizes)
            n += len(v)
            if n >= CHUNK:
                yield np.concatenate(held), np.concatenate(lengths)
                held, lengths, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(lengths)


def sliced(rows: DataFrame, first: int, slices: int, f, schema: str = "slot long, data binary") -> DataFrame:
    """Each slice to one task. Every slice has a row, so that each writes its file, entries or not."""
    every = rows.sparkSession.range(first, first + slices).select(F.col("id").alias("slot"), F.expr("X''").alias("data"))
    return rows.unionByName(every).repartition(slices, "slot").mapInArrow(tidy(f), schema)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from the numbers of entries with counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k) if n[k - 1] else 0.5 * k for k in (1, 2, 3))  # type: ignore[return-value]


@dataclass
class Model:
    folder: str
    slices: int
    words: Vocabulary
    tokens: int  # training tokens, ends included
    types: int  # distinct ones
    pair_discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    pairs: int  # distinct bigrams
    word_kinds: tuple[int, int, int]  # words with continuation count 1, 2, more
    order: int = 2
    triple_discount: tuple[float, float, float] = (0.0, 0.0, 0.0)
    start: tuple[int, int, int, int] = (0, 0, 0, 0)  # the start as a context: total, continuations of count 1, 2 and more

    def open(self) -> Reader:
        return Reader(self)


class Reader:
    """The model in one worker."""

    def __init__(self, model: Model):
        self.m, self.store, self.files, self.words = model, Store(model.folder), OrderedDict(), model.words.open()
        d, t = model.word_discount, max(model.pairs, 1)
        self.left = sum(x * y for x, y in zip(d, model.word_kinds, strict=True)) / t if model.pairs else 1.0

    def file(self, name: str) -> np.ndarray:
        if name not in self.files:
            self.files[name] = self.store.mapped(name)
            while self.store.path is None and len(self.files) > KEPT:
                self.files.popitem(last=False)
        return self.files[name]

    def each(self, kind: str, slot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each slice that is asked for: its file, and the places that ask."""
        for mine in _stretches(slot):
            yield self.file(f"{kind}-{slot[mine[0]]}"), mine

    def counts(self, kind: str, slot: np.ndarray, g: np.ndarray, facts: int = 1) -> np.ndarray:
        """Rows of facts of n-gram hashes; 0 where the model hasn't the n-gram."""
        out = np.zeros((facts, len(g)), np.int64)
        for data, mine in self.each(kind, slot):
            some = np.zeros((facts, len(mine)), np.int64)
            Slice(data, facts).facts(g[mine], some)
            out[:, mine] = some
        return out

    def word_facts(self, w: np.ndarray) -> np.ndarray:
        """Rows words before, total as context, continuations of count 1, 2 and more, of word numbers."""
        out = np.zeros((5, len(w)), np.int64)
        known = np.flatnonzero(w < self.m.types)
        for data, mine in self.each("words", (w[known] % np.uint64(self.m.slices)).astype(np.int64)):
            mine = known[mine]
            n, large = int(data[0]), int(data[1])
            size = -(-5 * n // 8)
            at = (w[mine] // np.uint64(self.m.slices)).astype(np.int64)
            some = data[2 : 2 + size].view(np.uint8)[: 5 * n].reshape(5, n)[:, at].astype(np.int64)
            place, there = _place(data[2 + size : 2 + size + large], at.astype(np.uint64))
            some[:, there] = data[2 + size + large :].reshape(5, large)[:, place[there]]
            out[:, mine] = some
        return out

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (g % np.uint64(self.m.slices)).astype(np.int64)

    def scores(self, v: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, log10 by add-one unigrams, log10 by the model."""
        m, starts = self.m, np.append(0, np.cumsum(sizes)[:-1])
        start = np.uint64(m.types)
        words, at = np.unique(v, return_inverse=True)
        number, count = self.words.find(words)
        facts, count, v = self.word_facts(number), count[at], number[at]
        below = np.maximum(facts[0] - _discount(facts[0], m.word_discount), 0) / max(m.pairs, 1) + self.left / (m.types + 1)
        g = pair(before(v, sizes, start), v)
        slot = self.slot(g)
        n = self.counts("pairs", slot, g)[0]
        contexts = [before(f[at], sizes, x) for f, x in zip(facts[1:], m.start, strict=True)]
        p = _interpolated(n, contexts[0], contexts[1:], m.pair_discount, below[at])
        if m.order == 3:
            # a pair is the context of what follows it: one continuation, unless an entry says more
            context = self.counts("contexts", slot, g, 4)
            context[:2, (n > 0) & (context[0] == 0)] = 1
            two = pair(np.array([start]), np.array([start]))
            lead = self.counts("contexts", self.slot(two), two, 4)
            context = [before(c, sizes, f[0]) for c, f in zip(context, lead, strict=True)]
            g, slot = before(g, sizes, two[0]), before(slot, sizes, self.slot(two)[0])
            p = _interpolated(self.counts("triples", slot, pair(g, v))[0], context[0], context[1:], m.triple_discount, p)
        base = np.log10((count + 1) / (m.tokens + (m.types + 1)))
        add = lambda x: np.add.reduceat(x, starts)
        return add((count > 0).astype(np.int64)), add(base), add(np.log10(p))


def _place(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sought among sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(sought), np.int64), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return at, keys[at] == sought


def _interpolated(c: np.ndarray, total: np.ndarray, kinds: np.ndarray, d: tuple[float, float, float], below: np.ndarray) -> np.ndarray:
    """Probability from the n-gram's count, its context's total and continuations of count 1, 2 and more, and the order below."""
    some, total = total > 0, np.maximum(total, 1)
    back = np.where(some, (d[0] * kinds[0] + d[1] * kinds[1] + d[2] * kinds[2]) / total, 1.0)
    return np.where(some, np.maximum(c - _discount(c, d), 0) / total, 0.0) + back * below


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([c == 1, c == 2, c > 2], d, 0.0)


def fits(most: int, columns: int) -> bool:
    """Whether so many numbers up to most fit 64 bits side by side."""
    return max(1, int(most).bit_length()) * columns <= 64


def grams(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers, in order, and how often each stands there.

    Rows are packed into 64 bits: the numbers themselves where they fit, else their places among the distinct ones.
    Where these don't fit either, rows are compared column by column.
    """
    table, most = None, max(int(c.max(initial=0)) for c in columns)
    if not fits(most, len(columns)):
        table, places = np.unique(np.concatenate(columns), return_inverse=True)
        columns, most = np.split(places.astype(np.uint64), len(columns)), len(table) - 1
    if fits(most, len(columns)):
        bits = max(1, int(most).bit_length())
        key = columns[0]
        for c in columns[1:]:
            key = key << np.uint64(bits) | c
        key, n = np.unique(key, return_counts=True)
        columns = [key >> np.uint64(bits * k) & np.uint64((1 << bits) - 1) for k in range(len(columns) - 1, -1, -1)]
    else:
        rows, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        columns = list(rows.T)
    return (columns if table is None else [table[c.astype(np.int64)] for c in columns]), n


def _kinds(c: np.ndarray) -> np.ndarray:
    return np.array([np.sum(c == k) for k in (1, 2, 3, 4)] + [len(c)], np.int64)


def _of_contexts(groups: np.ndarray, n: int, c: np.ndarray) -> list[np.ndarray]:
    """Total and continuations of count 1, 2 and more of each of n contexts; groups: the context of each row."""
    return [np.bincount(groups, x, n).astype(np.int64) for x in (c, c == 1, c == 2, c > 2)]


def fit(texts: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Counts the model over all given texts."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = texts.sparkSession
    folder, texts = shared_path(spark, "ngrams"), texts.select(named(texts, text).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]  # a token is about six characters
    slices = int(max(1, size // (6 * SLICE)))
    known = vocabulary(texts, size)
    start = np.uint64(known.types)
    of = lambda g: (g % np.uint64(slices)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.open()
        for v, sizes in chunks(batches):
            table, at = np.unique(v, return_inverse=True)
            number = np.append(words.find(table)[0], start)
            # places in the chunk's own list of numbers, in order, are small numbers
            order_of = np.argsort(number)
            place = np.empty(len(number), np.uint64)
            place[order_of] = np.arange(len(number), dtype=np.uint64)
            ids = [place[at]]
            for _ in range(order - 1):
                ids.insert(0, before(ids[0], sizes, place[-1]))
            # a very long text may have too many words for three places in 64 bits: its parts, context and all, are counted one by one
            step = len(at) if fits(len(number) - 1, order) else PIECE
            for i in range(0, len(at), step):
                found, n = grams([c[i : i + step] for c in ids])
                columns = [number[order_of[c.astype(np.int64)]] for c in found]
                yield dealt(of(pair(columns[0], columns[1])), [*columns, n])

    def write_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for slot, blocks in _by_slot(batches):
            t, u, v, c = loaded(blocks, 4)
            context = pair(t, u)
            g, first, c = summed(pair(context, v), c.astype(np.int64))
            u, v = u[first], v[first]
            store.write(f"triples-{slot}", _gram_file(g, [c]))
            yield _rows([-2], [_kinds(c).tobytes()])
            context, at = np.unique(context[first], return_inverse=True)
            facts = _of_contexts(at, len(context), c)
            # contexts met once go without an entry, but for the two starts, which are no known pair
            several = (facts[0] > 1) | (context == pair(np.array([start]), np.array([start])))
            store.write(f"contexts-{slot}", _gram_file(context[several], [f[several] for f in facts]))
            if len(c):
                (u, v), n = grams([u, v])
                yield dealt(of(pair(u, v)), [u, v, n])

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for slot, blocks in _by_slot(batches):
            if slot < 0:
                yield _rows([slot] * len(blocks), blocks)
                continue
            u, v, n = loaded(blocks, 3)
            g, first, n = summed(pair(u, v), n.astype(np.int64))
            u, v = u[first], v[first]
            store.write(f"pairs-{slot}", _gram_file(g, [n]))
            yield _rows([-1], [_kinds(n).tobytes()])
            if len(n):
                w, at = np.unique(np.append(u, v), return_inverse=True)
                facts = [np.bincount(at[len(u) :], None, len(w)), *_of_contexts(at[: len(u)], len(w), n)]
                yield dealt((w % np.uint64(slices)).astype(np.int64), [w, *facts], slices)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out = Store(folder), []
        for slot, blocks in _by_slot(batches):
            if slot < 0:
                told = np.frombuffer(b"".join(b for b in blocks if b), np.int64).reshape(-1, 5).sum(0).tolist()
                out.append(told + [0] * 15 if slot == -1 else [0] * 5 + told + [0] * 10)
                continue
            w, *rows = loaded(blocks, 6)
            mine = w < start
            n = (known.types - (slot - slices) + slices - 1) // slices  # numbers that belong to this slice
            at = (w[mine] // np.uint64(slices)).astype(np.int64)
            facts = np.stack([np.bincount(at, r[mine], n).astype(np.int64) for r in rows])
            large = np.flatnonzero((facts > 255).any(0))
            body = np.minimum(facts, 255).astype(np.uint8).tobytes()
            store.write(f"words-{slot - slices}", b"".join([np.array([n, len(large)], np.uint64).tobytes(), body, b"\0" * (-len(body) % 8), large.astype(np.uint64).tobytes(), facts[:, large].astype(np.uint64).tobytes()]))
            ahead = facts[0]
            leads = [int(r[~mine].sum()) for r in rows[1:]]
            out.append([0] * 10 + [int(np.sum(ahead == k)) for k in (1, 2, 3, 4)] + [int(np.sum(ahead > 2)), *leads, 0])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(_SUMS))], _SUMS)

    rows = texts.mapInArrow(tidy(count), "slot long, data binary")
    if order == 3:
        rows = sliced(rows, 0, slices, write_triples)
    rows = sliced(rows, 0, slices, write_pairs)
    sums = stored(sliced(rows, slices, slices, write_words, ", ".join(f"{s} long" for s in _SUMS)), "ngram-sums")
    s = [x or 0 for x in sums.agg(*(F.sum(c) for c in _SUMS)).first()]
    return Model(folder, slices, known, known.tokens, known.types, discounts(s[0:4]), discounts(s[10:14]), s[4], (s[10], s[11], s[14]), order, discounts(s[5:9]), tuple(s[15:19]))


_SUMS = ["p1", "p2", "p3", "p4", "pairs", "t1", "t2", "t3", "t4", "triples", "k1", "k2", "k3", "k4", "more", "total", "n1", "n2", "n3", "none"]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, base_score and score (log10 probabilities of the text) and perplexity."""
    added = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "perplexity": "double"}
    keep = [c for c in docs.columns if c not in added]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T._parse_datatype_string(k)) for c, k in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.open()
        for batch in batches:
            start, held, lengths, size, done = 0, [], [], 0, 0

            def flush() -> pa.RecordBatch:
                sizes = np.concatenate(lengths)
                known, base, full = reader.scores(np.concatenate(held), sizes)
                new = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), *(pa.array(x, pa.float64()) for x in (base, full, np.power(10.0, -full / sizes)))]
                part = batch.slice(start, done - start)
                return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], [*keep, *added])

            for v, sizes in tokens(batch.column(text)):
                held.append(v)
                lengths.append(sizes)
                size, done = size + len(v), done + len(sizes)
                if size >= CHUNK:
                    yield flush()
                    start, held, lengths, size = done, [], [], 0
            if held:
                yield flush()

    return map_rows(docs, run, schema)
