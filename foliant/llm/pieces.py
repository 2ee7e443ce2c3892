"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder is an agenda: all adjacent symbol pairs that form a vocabulary entry wait in a heap by
score (ties: leftmost first), the best pair merges, and its new neighbours join the heap. Symbols
outside the vocabulary fall back to byte entries.

A text is cut before encoding only where no vocabulary entry crosses the cut, so cutting changes
nothing: entries never hold a space mark after another character, and never mix letters with other
characters (`PieceModel` verifies both on the loaded vocabulary). Encoded cuts are remembered per
worker in memories of bounded size: two generations each, and what is met again moves on to the younger one, so frequent cuts
stay. Every cut that enters a memory is compared, a whole Arrow
stretch of rows at once, with the sentencepiece library; a difference stops the job.

Edge cases: null and empty texts encode to the end id alone and decode to the empty text; repeated
rows give repeated rows; an empty table gives an empty table; other columns pass through, and the
new columns replace input columns of the same names.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

MARK = "▁"
#: Remembered cuts per worker, of each kind and generation.
MEMORY = 130_000
#: Rows that become Python objects at a time.
ROWS = 512
#: Characters that often end a word; none is a letter or part of a longer run then.
ENDINGS = frozenset(",.;:!?")
#: Cuts of up to so many symbols have their agenda in an array, longer ones in a heap.
SHORT = 40


class Memory:
    """Two generations of a bounded size: a full young one becomes the old one, whose cuts come back as they are met."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, name: str, ids: bytes) -> None:
        if len(self.young) >= MEMORY:
            self.young, self.old = {}, self.young
        self.young[name] = ids


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos = lib.eos_id()
        #: Of mergeable entries: place in descending order of score (equal scores share it).
        self.place: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        scores = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i):
                self.bytes_of.append(b"")
            elif lib.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.ids[piece], scores[piece] = i, lib.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        order = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.last = len(order)
        self.place = {p: order[x] for p, x in scores.items() if len(p) > 1}
        for piece in self.ids:
            body = piece.lstrip(MARK)
            if MARK in body or len(piece) - len(body) > 1 and body or any(a.isalpha() != b.isalpha() for a, b in pairwise(body)):
                raise ValueError(f"entry {piece!r} crosses the cuts made here")
        self.wholes, self.parts = Memory(), Memory()

    def agenda(self, text: str) -> list[int]:
        """Ids of one cut, its spaces already marks."""
        out: list[int] = []
        ids = self.ids
        for s in self._merge_short(text) if len(text) <= SHORT else self._merge_long(text):
            if (x := ids.get(s)) is not None:
                out.append(x)
            else:
                out += [self.byte_id[b] for b in s.encode()]
        return out

    def _merge_short(self, text: str) -> list[str]:
        """The agenda as an array: the place of each adjacent pair, in order of position."""
        get, last = self.place.get, self.last
        symbols = list(text)
        agenda = [get(a + b, last) for a, b in pairwise(symbols)]
        while agenda and (best := min(agenda)) < last:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], last)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], last)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        """The agenda as a heap of (place, position of the left symbol, length of both)."""
        place, n = self.place, len(text)
        symbol, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, 2) for i in range(n - 1) if (k := place.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbol[i] or j >= n or len(both := symbol[i] + symbol[j]) != size:
                continue  # one of the two has merged with another since
            symbol[i], symbol[j] = both, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := place.get(p := both + symbol[k])) is not None:
                    heapq.heappush(heap, (x, i, len(p)))
            if (k := before[i]) >= 0 and (x := place.get(p := symbol[k] + both)) is not None:
                heapq.heappush(heap, (x, k, len(p)))
        return [s for s in symbol if s]

    def _cut(self, memory: Memory, name: str, part: str, new: list) -> bytes:
        """Ids of one part, remembered under a name."""
        if (got := memory.young.get(name)) is not None:
            return got
        if (got := memory.old.get(name)) is None:
            got = array("i", self.agenda(part)).tobytes()
            new.append((part, got))
        memory.keep(name, got)
        return got

    def _whole(self, word: str, new: list) -> bytes:
        """Ids of a space-led word from its parts: runs of letters and runs of other characters. Words of several parts aren't remembered, their parts are."""
        if word.isalpha():
            return self._cut(self.wholes, word, MARK + word, new)
        if word[-1:] in ENDINGS and word[:-1].isalpha():
            parts = [MARK + word[:-1], word[-1]]
        else:
            parts = _PARTS.findall(MARK + word)
        lead = self._cut(self.wholes, parts[0][1:], parts[0], new)
        return b"".join([lead, *[self._cut(self.parts, p, p, new) for p in parts[1:]]])

    def encode(self, text: str | None, new: list) -> bytes:
        """int32 ids of a whole text without the end id; new gets the cuts that were encoded anew."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            cuts = [c.replace(" ", MARK) for c in _SPACED.findall(" " + text)]
            return b"".join(self._whole(c[1:], new) for c in cuts)
        get = self.wholes.young.get
        return b"".join([x if (x := get(w)) is not None else self._whole(w, new) for w in text.split(" ")])

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        out = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    def verify(self, cuts: list[tuple[str, bytes]]) -> None:
        """Compares cuts with the library, each after a line break: that never merges, and keeps a space mark from being taken for the one that opens a text."""
        lead = len(self.library.encode("\n"))
        for (part, got), want in zip(cuts, self.library.encode(["\n" + p.replace(MARK, " ") for p, _ in cuts], num_threads=1) if cuts else [], strict=True):
            if got != array("i", want[lead:]).tobytes():
                raise ValueError(f"ids of {part!r} differ from the library's")


_SPACED = re.compile(" +[^ ]+| +")
#: Marks stay with what follows them.
_PARTS = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*(?:(?!{MARK})[\W\d_])+|{MARK}+")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of every whole text, closed by the end id, and the text that those ids decode to."""
    keep = [c for c in df.columns if c not in (ids, decoded)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        gc.disable()  # nothing here is cyclic, and the remembered cuts are many objects to walk
        end = array("i", [m.eos]).tobytes()
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                some = batch.slice(start, ROWS)
                new: list[tuple[str, bytes]] = []
                coded, texts, counts = [], [], []
                for t in some.column(text):
                    one = m.encode(t.as_py(), new)
                    texts.append(m.decode(np.frombuffer(one, np.int32).tolist()))
                    coded += (one, end)
                    counts.append(len(one) // 4 + 1)
                m.verify(new)
                flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                out = [*(some.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*keep, ids, decoded])

    return map_rows(df, run, schema)
