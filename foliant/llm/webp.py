"""Texts as images: payloads in lossless WebP, a codec over numpy arrays, and media columns made of it.

The decoder takes any lossless WebP image: all five prefix codes, simple and run-length coded, with groups by block; back-references with near
distances; the colour cache; and the inverse of the predictor, cross-colour, subtract-green and palette transforms. An image with one group of codes is
decoded array-wise: what begins at each bit is looked up for all bits of a stretch at once, then a walk from token to token picks the
bits where tokens do begin, and literals and copies are put in place; many such images are read in pieces side by side. With groups, tokens are read one by one. The predictor is inverted along
fronts of pixels that depend on earlier fronts only. Images of payloads are written side by side as well: copies, cache, codes and bits of all are found in one pass.

A payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of `ROW`. It is stored as images of at most `TILE` bytes, one file
after another, so that memory is bounded at any length. The layout "colour" has four bytes a pixel, with predictor, cross-colour transform and colour cache; all payloads take it
but those that `layout_of` finds unfit for it. The layouts "palette" and "grey" have one byte a pixel: a palette of the bytes that occur, by which few different bytes are packed, or grey
pixels less their green.

Edge cases: a null text is an empty one, and an empty one is 64 zero bytes; a null medium reads as null; equal texts give
equal media; very long texts become several images; an empty table gives an empty table. Other columns pass through; new
columns replace input columns of their names. A damaged file is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

ROW, TILE = 64, 1 << 20
#: Bytes that a copy has at least, pixels that a copy has at most.
WINDOW, LONGEST = 6, 4096
#: Bits of a stretch that is looked up at once, pixels of an image that is read token by token, bytes of payloads that are transformed together.
STRETCH, SMALL, TOGETHER = 1 << 17, 64, 1 << 21
#: Bytes of images from which on these are read side by side, and pixels of images that aren't.
ENOUGH, WIDEST = 1 << 15, 1 << 22
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: the order in which lengths of the code of lengths are stored, and the multiplier of the colour cache's hash.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_HASH = 0x1E35A7BD
OPAQUE = 0xFF000000
#: A complete code of code lengths that suits texts, by which a payload needs none of its own: bits of each of the 19 symbols.
LENGTHS_OF_LENGTHS = np.array([4, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 4, 4])
#: Near distances: places to the left of a pixel or above it, by their distance, then from the column of the pixel outwards.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# prefix codes


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a complete prefix code for these counts, none above most; one symbol alone has length 1.

    Lengths are the information of the symbols, rounded up. What that leaves of the code space shortens codes, frequent symbols first,
    then the longest codes, which always fit into what is left.
    """
    used = counts.nonzero()[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    n = counts.take(used)
    weight, whole = n, int(n.sum())
    while True:
        size = np.maximum(np.ceil(np.log2(whole / weight)), 1).astype(np.int64)
        size = np.minimum(size, most)
        left = (1 << most) - int((1 << (most - size)).sum())
        if left >= 0:
            break
        weight = weight + (whole >> 12) + 1  # too many rare symbols for codes of at most this length
        whole = int(weight.sum())
    order, sizes = (-n).argsort(kind="stable").tolist(), size.tolist()
    for k in order:
        if not left:
            break
        room = 1 << (most - sizes[k])
        if room <= left and sizes[k] > 1:
            sizes[k] -= 1
            left -= room
    while left:
        longest = max(sizes)
        for k in order:
            if sizes[k] == longest and left:
                sizes[k] -= 1
                left -= 1 << (most - longest)
    out[used] = sizes
    return out


@lru_cache(16)
def reversal(bits: int) -> np.ndarray:
    """Each number of so many bits with its bits turned round."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of symbols, first bit lowest. A symbol that stands alone takes no bits; its code is 0."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return out
    order = used[lengths[used].argsort(kind="stable")]
    top = int(lengths[order[-1]])
    share = 1 << (top - lengths[order])
    out[order] = reversal(top)[share.cumsum() - share]
    return out


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """By the next bits: 16 times the symbol plus the length of its code; and how many bits that are."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return np.array([16 * used[0] if len(used) else 0], np.int32), 0
    size = lengths[used]
    order = size.argsort(kind="stable")
    size = size.take(order)
    top = int(size[-1])
    share = 1 << (top - size)
    if int(share.sum()) != 1 << top:
        raise ValueError("not a complete prefix code")
    return (used.take(order) * 16 + size).astype(np.int32).repeat(share).take(reversal(top)), top


@lru_cache(1)
def _prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _prefixed(np.arange(1, 1 << 16))


def prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, number of extra bits, extra bits) of lengths or distances from 1; small ones, nearly all, from a table."""
    if value.max(initial=1) < 1 << 16:
        return tuple(t.take(value - 1) for t in _prefixes())
    return _prefixed(value)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = value - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + ((x >> np.maximum(high - 1, 0)) & 1)), extra, np.where(x < 4, 0, x & ((1 << extra) - 1))


@lru_cache(64)
def near_distances(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in NEAR])


@lru_cache(64)
def near_numbers(width: int) -> np.ndarray:
    """By distance: the least number of a near place at that distance, from 1; 0 where there is none."""
    out = np.zeros(8 * width + 16, np.int64)
    for k, d in reversed(list(enumerate(near_distances(width).tolist(), 1))):
        out[d] = k
    return out


# transforms, on arrays of channels (height, width, 4) in the order alpha, red, green, blue


def channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([(pixels >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int16)


def without_green(pixels: np.ndarray, back: bool) -> np.ndarray:
    """Red and blue less green, or the inverse."""
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    both, green = pixels & np.uint32(0xFF00FF), green | green << np.uint32(16)
    return pixels & np.uint32(0xFF00FF00) | (both + green if back else (both | np.uint32(0x1000100)) - green) & np.uint32(0xFF00FF)


def joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return (c[..., 0] << 24) | (c[..., 1] << 16) | (c[..., 2] << 8) | c[..., 3]


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _guess(mode: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What one mode says from the neighbours left, above, above right and above left; modes beyond the last say what the first does."""
    if 1 <= mode <= 4:
        return (a, b, c, d)[mode - 1]
    if 6 <= mode <= 9:
        return _half(*((a, d), (a, b), (d, b), (b, c))[mode - 6])
    if mode == 5:
        return _half(_half(a, c), b)
    if mode == 10:
        return _half(_half(a, d), _half(b, c))
    if mode == 11:
        nearer = np.abs(b - d).sum(1) < np.abs(a - d).sum(1)
        return np.where(nearer[:, None], a, b)
    if mode == 12:
        return np.clip(a + b - d, 0, 255)
    if mode == 13:
        mean = _half(a, b)
        off = mean - d
        return np.clip(mean + np.where(off < 0, -(-off >> 1), off >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], a.dtype), a.shape)


def predicted(modes: np.ndarray, *near: np.ndarray) -> np.ndarray:
    """Of pixels (n, 4): what their modes say from their neighbours."""
    kinds = np.bincount(modes, minlength=1).nonzero()[0].tolist()
    if len(kinds) == 1:
        return _guess(kinds[0], *near)
    out = np.empty_like(near[0])
    for m in kinds:
        k = modes == m
        out[k] = _guess(m, *(x[k] for x in near))
    return out


def spread(blocks: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """A value for each pixel from one for each block."""
    return np.repeat(np.repeat(blocks, 1 << bits, 0)[:height], 1 << bits, 1)[:, :width]


def border_modes(modes: np.ndarray, tops: np.ndarray | int = 0) -> np.ndarray:
    """The first row follows its left neighbour, the first column its upper one, the first pixel none. tops: the first rows of images that stand one below another."""
    modes = modes.copy()
    modes[tops], modes[:, 0], modes[tops, 0] = 1, 2, 0
    return modes


def _neighbours(c: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    flat, at, width = c.reshape(-1, 4), y * c.shape[1] + x, c.shape[1]
    return tuple(flat[np.maximum(k, 0)] for k in (at - 1, at - width, at - width + 1, at - width - 1))  # no mode reads places before the first pixel


def predict_residuals(c: np.ndarray, modes: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(modes.size), modes.shape[1])
    return (c - predicted(border_modes(modes).ravel(), *_neighbours(c, y, x)).reshape(c.shape)) & 255


#: Modes that look at the pixel to the left.
LEFTWARDS = np.isin(np.arange(16), (1, 5, 6, 7, 10, 11, 12, 13))


def predict_back(c: np.ndarray, modes: np.ndarray, tops: np.ndarray | None = None) -> np.ndarray:
    """The inverse, of images that stand one below another. First rows add up from left to right; later ones are whole steps, a row of each image in one, as long as no mode
    of theirs looks to the left, else an image goes on by fronts: pixels with equal x + 2y depend on those of lesser sums only."""
    tops = np.zeros(1, np.int64) if tops is None else tops
    heights = np.diff(tops, append=len(c))
    out, modes = c.copy(), border_modes(modes, tops)
    out[tops, 0, 0] += 255
    out[tops] = out[tops].cumsum(1, dtype=np.int64) & 255
    led = LEFTWARDS[modes].any(1)
    led[tops] = False
    stops, led = heights.copy(), led.nonzero()[0]
    if len(led):
        image = np.searchsorted(tops, led, "right") - 1
        np.minimum.at(stops, image, led - tops[image])
    order = (-stops).argsort(kind="stable")
    first, live = tops[order], np.searchsorted(-stops[order], -np.arange(int(stops.max())), "left")  # images with more rows than that
    for done in range(1, int(stops.max())):
        rows = first[: live[done]] + done
        here, above = out[rows], out[rows - 1]
        last = (here[:, :1] + above[:, :1]) & 255  # the right neighbour above the last pixel is the first one of its own row
        near = above, above, np.concatenate([above[:, 1:], last], 1), np.concatenate([above[:, :1], above[:, :-1]], 1)
        out[rows] = (here + predicted(modes[rows].ravel(), *(x.reshape(-1, 4) for x in near)).reshape(here.shape)) & 255
    for k in (stops < heights).nonzero()[0].tolist():
        mine = slice(tops[k], tops[k] + heights[k])
        _fronts(out[mine], modes[mine], int(stops[k]))
    return out


def _fronts(out: np.ndarray, modes: np.ndarray, done: int) -> None:
    height, width = modes.shape
    for t in range(2 * done, width + 2 * (height - 1)):
        y = np.arange(max(done, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        x = t - 2 * y
        out[y, x] = (out[y, x] + predicted(modes[y, x], *_neighbours(out, y, x))) & 255


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def cross_colour(c: np.ndarray, factors: np.ndarray, back: bool) -> np.ndarray:
    """factors: red to blue, green to blue and green to red of each pixel, as channels red, green and blue."""
    out = c.astype(np.int32)
    green, sign = c[..., 2], 1 if back else -1
    red = (out[..., 1] + sign * _delta(factors[..., 3], green)) & 255
    true_red = red if back else c[..., 1]
    out[..., 3] = (out[..., 3] + sign * (_delta(factors[..., 2], green) + _delta(factors[..., 1], true_red))) & 255
    out[..., 1] = red
    return out.astype(np.int16)


def palette_bits(colours: int) -> int:
    """Pixels are packed into one by so many doublings."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# reading


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(16), at

    def read(self, n: int) -> int:
        i = self.at >> 3
        out = (int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: tuple[list, int]) -> int:
        i = self.at >> 3
        k = table[0][(int.from_bytes(self.data[i : i + 3], "little") >> (self.at & 7)) & ((1 << table[1]) - 1)]
        self.at += k & 15
        return k >> 4


@lru_cache(64)
def _length_table(of_lengths: bytes) -> tuple[list[int], int]:
    table, top = lookup(np.frombuffer(of_lengths, np.int64))
    return table.tolist(), (1 << top) - 1


def _simple(bits: Bits, alphabet: int) -> tuple[int, ...] | None:
    """The one or two symbols of a simple code; None of another."""
    if not bits.read(1):
        return None
    several, wide = bits.read(1), bits.read(1)
    symbols = (bits.read(8 if wide else 1), *((bits.read(8),) if several else ()))
    if max(symbols) >= alphabet:
        raise ValueError("a symbol outside of the alphabet")
    return symbols


@lru_cache(1 << 12)
def _simple_table(symbols: tuple[int, ...]) -> tuple[np.ndarray, int]:
    lengths = np.zeros(256, np.int64)
    lengths[list(symbols)] = 1
    return lookup(lengths)


@lru_cache(1)
def _usual_runs() -> list[tuple[int, list[int]]]:
    """By the next 15 bits in the usual code: how many of them lengths below 16 take before any other symbol, and these lengths."""
    table, mask = _length_table(LENGTHS_OF_LENGTHS.tobytes())
    out = []
    for x in range(1 << 15):
        at, found = 0, []
        while (k := table[(x >> at) & mask]) < 256 and at + (k & 15) <= 15:
            found.append(k >> 4)
            at += k & 15
        out.append((at, found))
    return out


def read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    out, simple = np.zeros(alphabet, np.int64), _simple(bits, alphabet)
    if simple:
        out[list(simple)] = 1
        return out
    of_lengths = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = _length_table(of_lengths.tobytes())
    runs = _usual_runs() if left == alphabet and (of_lengths == LENGTHS_OF_LENGTHS).all() else None
    found, at, data, n = [], bits.at, bits.data, 0
    while len(found) < alphabet and left:
        i = at >> 3
        ahead = int.from_bytes(data[i : i + 7], "little") >> (at & 7)
        if runs:
            n, some = runs[ahead & 32767]
            if n:
                found += some
                at += n
                continue
        left -= 1
        k = table[ahead & mask]
        ahead >>= k & 15
        at += k & 15
        k >>= 4
        if k < 16:
            found.append(k)
        elif k == 16:
            found += [next((x for x in reversed(found) if x), 8)] * (3 + (ahead & 3))
            at += 2
        elif k == 17:
            found += [0] * (3 + (ahead & 7))
            at += 3
        else:
            found += [0] * (11 + (ahead & 127))
            at += 7
        if at > 8 * len(data):
            raise ValueError("the image ends early")
    if n and len(found) > alphabet:  # the last run reached beyond the code: lengths are taken back one by one
        while len(found) > alphabet:
            at -= int(LENGTHS_OF_LENGTHS[found.pop()])
    bits.at = at
    if len(found) > alphabet:
        raise ValueError("more code lengths than symbols")
    out[: len(found)] = found
    return out


def read_table(bits: Bits, alphabet: int) -> tuple[np.ndarray, int]:
    """`lookup` of a code."""
    at = bits.at
    simple = _simple(bits, alphabet)
    if simple:
        return _simple_table(simple)
    bits.at = at
    return lookup(read_lengths(bits, alphabet))


def _value(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """Pixels (height, width) of an entropy-coded image; the main one may have groups of codes."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("a colour cache of more than 11 bits")
    groups = None
    if main and bits.read(1):
        block = bits.read(3) + 2
        blocks = (read_image(bits, -(-width >> block), -(-height >> block)) >> 8) & 0xFFFF
        groups = spread(blocks, block, height, width).ravel()
    sizes = (280 + (1 << cache if cache else 0), 256, 256, 256, 40)
    tables = [[read_table(bits, n) for n in sizes] for _ in range(int(groups.max()) + 1 if groups is not None else 1)]
    if groups is None and not main and width * height <= SMALL:
        pixels = _read_each(bits, tables, None, width, width * height, cache)
    elif groups is None:
        pixels = _read_array(bits, tables[0], width, width * height, cache)
    else:
        pixels = _read_each(bits, tables, groups.tolist(), width, width * height, cache)
    return pixels.reshape(height, width)


def _read_each(bits: Bits, tables: list, groups: list[int] | None, width: int, n: int, cache: int) -> np.ndarray:
    """Token after token, the code by the pixel's group."""
    lists = [[(t.tolist(), top) for t, top in group] for group in tables]
    near, out, slots = near_distances(width).tolist(), [], [0] * (1 << cache)
    shift = 32 - cache

    def put(p: int) -> None:
        out.append(p)
        if cache:
            slots[((p * CACHE_HASH) & 0xFFFFFFFF) >> shift] = p

    while len(out) < n:
        mine = lists[groups[len(out)] if groups else 0]
        s = bits.symbol(mine[0])
        if s < 256:
            red, blue, alpha = bits.symbol(mine[1]), bits.symbol(mine[2]), bits.symbol(mine[3])
            put(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length, far = _value(s - 256, bits), _value(bits.symbol(mine[4]), bits)
            far = far - 120 if far > 120 else near[far - 1]
            if far > len(out) or len(out) + length > n:
                raise ValueError("a copy that leaves the image")
            for _ in range(length):
                put(out[-far])
        else:
            put(slots[s - 280])
        if bits.at > 8 * (len(bits.data) - 16):
            raise ValueError("the image ends early")
    return np.array(out, np.uint32)


def _read_array(bits: Bits, tables: list, width: int, n: int, cache: int) -> np.ndarray:
    """The same for one group, array-wise."""
    raw = np.frombuffer(bits.data, np.uint8)
    end, found, have = 8 * (len(bits.data) - 16), [], 0
    while have < n:
        if bits.at >= end and any(top for _, top in tables[:4]):
            raise ValueError("the image ends early")
        tokens = _stretch(bits, raw, tables, width, n - have)
        found.append(tokens)
        have += int(tokens[1].sum())
    if bits.at > end or have > n:
        raise ValueError("the image ends early" if bits.at > end else "a copy that leaves the image")
    value, length, far = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    at = np.cumsum(length) - length
    copies = np.flatnonzero(far > 0)
    if (far[copies] > at[copies]).any():
        raise ValueError("a copy that leaves the image")
    if cache and (far < 0).any():
        return _with_cache(value, length, far, n, cache)
    out = np.empty(n, np.uint32)
    if len(copies):
        out[at[far == 0]] = value[far == 0]
        for i, k, d in zip(at[copies].tolist(), length[copies].tolist(), far[copies].tolist(), strict=True):
            if d >= k:
                out[i : i + k] = out[i - d : i - d + k]
            else:
                out[i : i + k] = np.resize(out[i - d : i], k)
    else:
        out[:] = value
    return out


def _with_cache(value: np.ndarray, length: np.ndarray, far: np.ndarray, n: int, cache: int) -> np.ndarray:
    """Pixels where some come from the cache. Each pixel points to where it comes from: a copied one to its source, one from the cache to the last pixel before it of the same
    slot, a literal to itself. Pointers double until all end at literals, or at a zero behind the last pixel, with which the cache begins."""
    at = np.arange(n)
    far = far.repeat(length)
    from_copy, hit = far > 0, far < 0
    value = np.append(value.astype(np.uint32).repeat(length), np.uint32(0))
    ends = _ends(np.where(from_copy, at - far, at))
    slot = np.where(hit, value[:-1], (value[:-1] * np.uint32(CACHE_HASH)) >> np.uint32(32 - cache))[ends]
    order = slot.argsort(kind="stable")
    before = np.full(n, n)
    same = slot[order[1:]] == slot[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return value[_ends(np.append(np.where(hit, before, ends), n))[:-1]]


def _ends(to: np.ndarray) -> np.ndarray:
    """Where pointers end that point to places no later, or to the last place of all."""
    while True:
        further = to[to]
        if (further == to).all():
            return to
        to = further


def _stretch(bits: Bits, raw: np.ndarray, tables: list, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of at most so many pixels whose first bit lies in the next stretch: (pixel or place in the cache, length, distance; 0 for literals, -1 for the cache)."""
    first = bits.at >> 3
    size = min(STRETCH >> 3, len(raw) - 16 - first, 14 * most + 1)  # a token has 106 bits at most
    words = np.ndarray((max(min(size + 16, len(raw) - first - 8), 1),), "<u8", raw, first, (1,))
    window = (words[:, None] >> np.arange(8, dtype=np.uint64)).view(np.int64).ravel()  # of each bit: it and the 56 or more that follow
    bound, n = 8 * size, len(window)

    def at_each(table: tuple[np.ndarray, int], mine: np.ndarray = window) -> np.ndarray:
        return table[0].take(mine & ((1 << table[1]) - 1))

    entry = at_each(tables[0])
    start = after = np.arange(n, dtype=np.int32) + (entry & 15)
    parts = []
    for table in tables[1:4]:  # red, blue and alpha of literals
        if table[1]:
            e = at_each(table)
            after = np.minimum(after, n - 1)
            e = e.take(after)
            parts.append(e >> 4)
            after = after + np.where(entry < 4096, e & 15, 0)
        else:
            parts.append(table[0][0] >> 4)
    highest = int(tables[0][0].max())
    copy = (entry >= 4096).nonzero()[0] if highest >= 4096 else np.empty(0, np.int64)
    if highest >= 4480:
        copy = copy[entry[copy] < 4480]
    if len(copy):
        length_at, k = _extra((entry.take(copy) >> 4) - 256, window, np.minimum(start.take(copy), n - 1))
        k = np.minimum(k, n - 1)
        e = at_each(tables[4], window.take(k))
        far_at, after[copy] = _extra(e >> 4, window, np.minimum(k + (e & 15), n - 1))
    at, most_tokens = bits.at & 7, most
    if not any(top for _, top in tables[:4]) and entry[0] < 4096:  # all pixels alike take no bits
        place, stop = np.full(most, at, np.int32), at
    else:
        # three of four tokens are found from the fourth before
        ends = np.minimum(after, n - 1)
        two = ends.take(ends)
        steps, walk = memoryview(two.take(two)), []
        while at < bound and most_tokens > 0:
            walk.append(at)
            at = steps[at]
            most_tokens -= 4
        place = np.empty((len(walk), 4), np.int32)
        place[:, 0] = walk
        for k in range(3):
            place[:, k + 1] = ends.take(place[:, k])
        place = place.ravel()[:most]
        place = place[: int(np.searchsorted(place, bound))] if place[-1] >= bound else place
        stop = int(after[place[-1]])
    s = entry.take(place) >> 4
    length, far = np.ones(len(place), np.int64), np.zeros(len(place), np.int64)
    if len(copy):
        mine = np.flatnonzero((s >= 256) & (s < 280))
        k = np.searchsorted(copy, place[mine])
        length[mine], d = length_at[k], far_at[k]
        far[mine] = np.where(d > 120, d - 120, near_distances(width)[np.minimum(d, 120) - 1])
        kept = int(np.searchsorted(np.cumsum(length), most)) + 1  # what stands after the last pixel is no token
        if kept < len(place):
            stop, place, s, length, far = int(place[kept]), place[:kept], s[:kept], length[:kept], far[:kept]
    bits.at = 8 * first + stop
    red, blue, alpha = (p.take(place) if isinstance(p, np.ndarray) else p for p in parts)
    value = (np.asarray(alpha, np.uint32) << np.uint32(24)) | (np.asarray(red, np.uint32) << np.uint32(16)) | np.asarray(blue, np.uint32) | (s.astype(np.uint32) << np.uint32(8))
    if highest >= 4480:
        hit = s >= 280
        value[hit], far[hit] = s[hit] - 280, -1
    return value, length, far


def _extra(symbol: np.ndarray, window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values from 1 of prefix symbols, and the bit after their extra bits."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    bits = window.take(at) & ((1 << extra) - 1)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + bits) + 1, at + extra


def _opened(data: bytes) -> tuple[list[tuple], Bits, int, int]:
    """The transforms of a file, in the order of writing, and its bits before its pixels, with their width and height."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP image")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    transforms, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (x[0] for x in transforms):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            transforms.append((kind, wide, block, read_image(bits, -(-wide >> block), -(-height >> block))))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            table = joined(np.cumsum(channels(read_image(bits, size, 1)), 1))[0]
            transforms.append((kind, wide, palette_bits(size), table))
            wide = -(-wide >> palette_bits(size))
        else:
            transforms.append((kind, wide, 0, None))
    return transforms, bits, wide, height


def _read_mains(opened: list[tuple[Bits, int, int]]) -> list[np.ndarray]:
    """The main images (height, width) of files. Those with one group of codes are read side by side, in runs of bounded size, if they are enough data."""
    out, sides, data, area = [None] * len(opened), [], 0, 0

    def flush() -> None:
        if data >= ENOUGH:
            for (k, _), pixels in zip(sides, _Sides([x for _, x in sides]).pixels(), strict=True):
                out[k] = pixels
        sides.clear()

    for k, (bits, width, height) in enumerate(opened):
        at = bits.at
        cache = bits.read(4) if bits.read(1) else 0
        if cache <= 11 and not bits.read(1) and width * height <= WIDEST:
            sides.append((k, (bits.data, bits.at, cache, width, width * height)))
            data, area = data + len(bits.data), area + width * height
            if data >= TOGETHER or area >= WIDEST:
                flush()
                data = area = 0
        bits.at = at
    flush()
    return [read_image(*opened[k], True) if x is None else x.reshape(opened[k][2], opened[k][1]) for k, x in enumerate(out)]


class _Sides:
    """Main images read side by side: (data, first bit of the codes, bits of the cache, width, pixels) of each.

    The bits of each image are cut into pieces, and a step goes from token to token in all pieces. Where a piece's first token begins is known when the piece before it is done; until then a piece is
    read from its first bit, as readings soon meet. Those that began elsewhere are read again from where they should, up to a token that was met before.
    """

    #: Bits of a piece, times that pieces are read again before their image is left to `read_image`, words behind the last image that a damaged one may reach.
    PIECE, ROUNDS, BEHIND = 4096, 8, 4096

    def __init__(self, images: list[tuple[bytes, int, int, int, int]]):
        size = np.array([len(x[0]) for x in images])
        room = -(-size >> 3) << 3
        base = 8 * (np.cumsum(room) - room)
        self.words = np.frombuffer(b"".join(x[0] + bytes(-len(x[0]) % 8) for x in images) + bytes(8 * self.BEHIND), "<u8")
        self.at, self.end = base + np.array([x[1] for x in images]), base + 8 * (size - 16)
        self.cache, self.width, self.n = (np.array([x[k] for x in images]) for k in (2, 3, 4))

    def ahead(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits that follow."""
        i, s = at >> 6, (at & 63).view(np.uint64)
        return ((self.words.take(i) >> s) | ((self.words.take(i + 1) << np.uint64(1)) << (np.uint64(63) - s))).view(np.int64)

    def look(self) -> None:
        if (self.at > self.end).any():
            raise ValueError("the image ends early")

    def pixels(self) -> list[np.ndarray | None]:
        """Of each image; None if it is left to `read_image`."""
        tables, bases, tops, many = [], [], [], len(self.n)
        for alphabet in (280 + np.where(self.cache > 0, 1 << self.cache, 0), *(np.full(many, a) for a in (256, 256, 256, 40))):
            table, base, top = _tables(many, *self.lengths(alphabet))
            bases.append(base + sum(map(len, tables)))
            tables.append(table)
            tops.append(top)
        self.table, self.bases, self.masks = np.concatenate(tables), bases, [(1 << t) - 1 for t in tops]
        return self.put(*self.places(tops[0] > 0))  # without green's bits a token may take none

    def tokens(self, image: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """What begins at bits: (entries of green, red, blue and alpha, bits that the token takes, which are copies, lengths and distances of these as they are stored)."""
        w, found, each = self.ahead(at), [], []
        for base, mask in zip(self.bases[:4], self.masks[:4], strict=True):
            e = self.table.take((w & mask.take(image)) + base.take(image))
            found.append(e)
            k = e & 15
            each.append(k)
            w >>= k
        size = each[0]
        rest = each[1] + each[2] + each[3]
        other = found[0] >= 4096
        rest[other] = 0
        size = size + rest
        copy = (other & (found[0] < 4480)).nonzero()[0]
        then, who = at.take(copy) + size.take(copy), image.take(copy)
        length, more = _valued((found[0].take(copy) >> 4) - 256, self.ahead(then))
        then += more
        k = self.table.take((self.ahead(then) & self.masks[4].take(who)) + self.bases[4].take(who))
        then += k & 15
        far, more = _valued(k >> 4, self.ahead(then))
        size[copy] = then + more - at.take(copy)
        return *found, size, copy, length, far

    def places(self, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens begin, and which images are still fit."""
        n = np.where(fit, np.maximum(-((self.at - self.end) // self.PIECE), 1), 0)
        image = np.arange(len(n)).repeat(n)
        first = np.cumsum(n) - n
        nth = np.arange(len(image)) - first.repeat(n)
        start = self.at[image] + nth * self.PIECE
        stop = np.minimum(start + self.PIECE, self.end[image])
        met = np.zeros(64 * len(self.words), np.int32)  # by bit: the last reading that had a token there, from 1
        piece, entry = np.arange(len(image)), start.copy()
        out_at, reading = np.zeros(len(image), np.int64), np.zeros(len(image), np.int64)
        ends, parent, joint, log = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], []
        for _ in range(self.ROUNDS):
            ids = sum(map(len, ends)) + np.arange(len(piece))
            end, up, where, some = self.walk(image[piece], entry[piece], stop[piece], ids, met)
            for k, at in some:
                met[at] = k
            log += some
            ends.append(end)
            merged = up > 0
            end[merged] = np.concatenate(ends)[up[merged]]
            parent.append(up)
            joint.append(where)
            reading[piece], out_at[piece] = ids, end
            want = np.where(nth > 0, np.append(0, out_at[:-1]), entry)
            piece = (want != entry).nonzero()[0]
            entry = want
            if not len(piece):
                break
        fit = fit.copy()
        fit[image[piece]] = False
        parent, joint = np.concatenate(parent), np.concatenate(joint)
        since = np.full(len(parent), np.iinfo(np.int64).max)
        good = fit[image]
        now, at = reading[good], entry[good]
        while len(now):
            since[now] = at
            on = parent[now] > 0
            now, at = parent[now[on]], joint[now[on]]
        reading, at = (np.concatenate(x) for x in zip(*log, strict=True)) if log else (np.zeros(0, np.int64),) * 2
        true = np.zeros(len(met), bool)
        true[at[at >= since.take(reading)]] = True
        return true.nonzero()[0], fit

    def walk(self, image: np.ndarray, at: np.ndarray, stop: np.ndarray, ids: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Readings from bits to the first token that begins behind their piece, or that an earlier reading met: (where that is, 0 if it was met; the reading that met it; where; tokens of readings)."""
        end, up, joint, log = at.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), []
        live = np.arange(len(at))
        bases, masks = self.bases, self.masks
        g = [(b.take(image), m.take(image)) for b, m in zip(bases, masks, strict=True)]
        table, ahead = self.table, self.ahead
        while len(live):
            before = met.take(at)
            gone = (at >= stop) | (before > 0)
            if gone.any():
                k = gone.nonzero()[0]
                late = at[k] >= stop[k]
                end[live[k]], up[live[k]], joint[live[k]] = at[k], np.where(late, 0, before[k]), at[k]
                stay = (~gone).nonzero()[0]
                live, at, stop, ids = (x.take(stay) for x in (live, at, stop, ids))
                g = [(b.take(stay), m.take(stay)) for b, m in g]
                if not len(live):
                    break
            for _ in range(8):
                log.append((ids, at))
                w = ahead(at)
                e = table.take((w & g[0][1]) + g[0][0])
                k = e & 15
                w >>= k
                size = table.take((w & g[1][1]) + g[1][0]) & 15
                w >>= size
                k2 = table.take((w & g[2][1]) + g[2][0]) & 15
                w >>= k2
                size += k2
                size += table.take((w & g[3][1]) + g[3][0]) & 15
                other = (e >= 4096).nonzero()[0]
                size[other] = 0
                size += k
                if len(other):
                    kinds = e.take(other)
                    copy = other[kinds < 4480]
                    then = at.take(copy) + size.take(copy)
                    s = (e.take(copy) >> 4) - 256
                    then += _MORE.take(s)
                    k = table.take((ahead(then) & g[4][1].take(copy)) + g[4][0].take(copy))
                    size[copy] = then - at.take(copy) + (k & 15) + _MORE.take(k >> 4)
                at = at + size
                if (at >= stop).any():
                    break
        return end, up, joint, log

    def put(self, place: np.ndarray, fit: np.ndarray) -> list[np.ndarray | None]:
        """The pixels that tokens stand for. Each pixel points to where it comes from: a copied one to its source, one from the cache to the last pixel before it of the same slot, a literal to itself."""
        image = np.searchsorted(self.at, place, "right") - 1
        green, red, blue, alpha, size, copy, copied, far_code = self.tokens(image, place)
        length, far = np.ones(len(place), np.int64), np.zeros(len(place), np.int64)
        widths, kind = np.unique(self.width, return_inverse=True)
        near = np.array([near_distances(int(x)) for x in widths]).ravel()
        length[copy] = copied
        far[copy] = np.where(far_code > 120, far_code - 120, near.take(120 * kind.ravel().take(image.take(copy)) + np.minimum(far_code, 120) - 1))
        have = np.cumsum(length)
        tokens = np.bincount(image, minlength=len(self.n))
        first = np.cumsum(tokens) - tokens
        before = np.append(0, have)[first]
        at = have - length - before.take(image)
        true = at < self.n.take(image)
        got = np.zeros(len(self.n), np.int64)
        np.maximum.at(got, image[true], (at + length)[true])
        if (got < self.n)[fit].any() or (place + size > self.end.take(image))[true].any():
            raise ValueError("the image ends early")
        if (got > self.n)[fit].any() or (far > at)[true].any():
            raise ValueError("a copy that leaves the image")
        green, red, blue, alpha, length, far, image = (x[true] for x in (green, red, blue, alpha, length, far, image))
        n = np.where(fit, self.n, 0)
        symbol = green >> 4
        cached = symbol >= 280
        value = ((alpha >> 4) << 24 | (red >> 4) << 16 | blue >> 4 | (symbol & 255) << 8).view(np.uint32)
        total = int(n.sum())
        begins = np.cumsum(n) - n
        if len(value) == total and not cached.any():
            out = value
        else:
            at = np.arange(total)
            ends = np.append(_ends(np.append(at - far.repeat(length), total)), 0)[:total]
            value, cached = value.repeat(length), cached.repeat(length)
            if cached.any():
                mine = np.arange(len(n)).repeat(n)
                slot = np.where(cached, (symbol - 280).repeat(length), ((value * np.uint32(CACHE_HASH)).astype(np.int64) >> (32 - self.cache).take(mine)))[ends]
                order = np.sort((mine << 11 | slot) << 26 | at)
                group, order = order >> 26, order & (1 << 26) - 1
                back = np.full(total, total)
                same = group[1:] == group[:-1]
                back[order[1:][same]] = order[:-1][same]
                ends = _ends(np.append(np.where(cached[ends] & (ends == at), back, ends), total))[:total]
            out = np.append(value, np.uint32(0))[ends]
        return [x if ok else None for x, ok in zip(np.split(out, begins[1:]), fit.tolist(), strict=True)]

    def lengths(self, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next code of each image: (image, symbol, length), by image and symbol."""
        w = self.ahead(self.at)
        simple = (w & 1) == 1
        several, wide = simple & ((w >> 1 & 1) == 1), (w >> 2 & 1) == 1
        first, bits = np.where(wide, w >> 3 & 255, w >> 3 & 1), np.where(wide, 11, 4)
        second = w >> bits & 255
        if (np.maximum(first, np.where(several, second, 0)) >= alphabet)[simple].any():
            raise ValueError("a symbol outside of the alphabet")
        alone, pair = simple.nonzero()[0], (several & (first != second)).nonzero()[0]
        image, symbol, length = [alone, pair], [first[alone], second[pair]], [np.ones(len(alone) + len(pair), np.int64)]
        self.at = self.at + np.where(simple, bits + 8 * several, 0)
        mine = (~simple).nonzero()[0]
        if len(mine):
            count, at = 4 + (w[mine] >> 1 & 15), self.at[mine] + 5
            w = self.ahead(at)
            of = np.zeros((len(mine), 19), np.int64)
            for k, order in enumerate(LENGTH_ORDER):
                of[:, order] = np.where(k < count, w >> (3 * k) & 7, 0)
            at += 3 * count
            w = self.ahead(at)
            bits = 2 + 2 * (w >> 1 & 7)
            bounded = (w & 1) == 1
            most, left = alphabet[mine], np.where(bounded, 2 + (w >> 4 & (1 << bits) - 1), alphabet[mine])
            at += np.where(bounded, 4 + bits, 1)
            kinds, kind = np.unique((of << 3 * np.arange(19)).sum(1), return_inverse=True)
            tables = np.array([lookup7(tuple(int(x) >> 3 * k & 7 for k in range(19))) for x in kinds.tolist()]).ravel()
            live, pos, last, kind = np.arange(len(mine)), np.zeros(len(mine), np.int64), np.full(len(mine), 8), 128 * kind.ravel()
            runs = []
            while len(live):
                w = self.ahead(at)
                e = tables.take(kind + (w & 127))
                s, size = e >> 4, e & 15
                extra = _EXTRA.take(s)
                n = _LEAST.take(s) + ((w >> size) & ((1 << extra) - 1))
                last = np.where((s < 16) & (s > 0), s, last)
                value = np.where(s > 16, 0, np.where(s == 16, last, s))
                k = value.nonzero()[0]
                runs.append((live.take(k), pos.take(k), n.take(k), value.take(k)))
                at, pos, left = at + size + extra, pos + n, left - 1
                stay = (pos < most) & (left > 0)
                if not stay.all():
                    if (pos > most).any():
                        raise ValueError("more code lengths than symbols")
                    self.at[mine[live[~stay]]] = at[~stay]
                    live, at, pos, left, most, last, kind = (x[stay] for x in (live, at, pos, left, most, last, kind))
            who, pos, n, value = (np.concatenate(x) for x in zip(*runs, strict=True))
            image.append(mine[who.repeat(n)])
            symbol.append((pos - (np.cumsum(n) - n)).repeat(n) + np.arange(int(n.sum())))
            length.append(value.repeat(n))
        self.look()
        image, symbol, length = (np.concatenate(x) for x in (image, symbol, length))
        order = np.argsort(image << 12 | symbol)
        return image[order], symbol[order], length[order]


#: Of symbols of a code of lengths: the least number of lengths that they stand for, and their extra bits.
_LEAST, _EXTRA = np.array([1] * 16 + [3, 3, 11]), np.array([0] * 16 + [2, 3, 7])
#: Extra bits of prefix symbols.
_MORE = np.array([0, 0, 0, 0] + [k >> 1 for k in range(2, 38)])


@lru_cache(1 << 10)
def lookup7(of_lengths: tuple[int, ...]) -> np.ndarray:
    """`lookup` of a code of lengths, by seven bits."""
    table, top = lookup(np.array(of_lengths))
    return table[np.arange(128) & ((1 << top) - 1)].astype(np.int64)


def _valued(symbol: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values from 1 of prefix symbols, and how many extra bits they took of those ahead."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + (ahead & ((1 << extra) - 1))) + 1, extra


def _tables(many: int, image: np.ndarray, symbol: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`lookup` of a code of each image, one after another, where each begins, and its bits."""
    top = np.zeros(many, np.int64)
    np.maximum.at(top, image, size)
    top[np.bincount(image, minlength=many) < 2] = 0
    by_top = top.argsort(kind="stable")
    rank = np.empty(len(top), np.int64)
    rank[by_top] = np.arange(len(top))
    top_of = top.take(image)
    order = np.argsort((rank.take(image) << 4 | size) << 12 | symbol)
    image, symbol, size, top_of = image.take(order), symbol.take(order), np.where(top_of > 0, size, 0).take(order), top_of.take(order)
    share = 1 << (top_of - size)
    held, entries = np.bincount(image, share, len(top)).astype(np.int64), 1 << top
    none = (held == 0).nonzero()[0]
    if (held != entries)[held > 0].any():
        raise ValueError("not a complete prefix code")
    plain, base, out, done = (symbol << 4 | size).astype(np.int32).repeat(share), np.zeros(len(top), np.int64), [np.zeros(1, np.int32)], 0
    here = 1
    for t, n in zip(*(x.tolist() for x in np.unique(top, return_counts=True)), strict=True):
        mine = by_top[np.searchsorted(top[by_top], t) :][:n]
        mine = mine[held[mine] > 0]
        many = len(mine) << t
        out.append(plain[done : done + many].reshape(-1, 1 << t).take(reversal(t), 1).ravel())
        base[mine] = here + (np.arange(len(mine)) << t)
        done, here = done + many, here + many
    base[none] = 0  # a code without symbols reads as its first one
    return np.concatenate(out), base, top


def _inverted(transforms: list[list[tuple]], pixels: list[np.ndarray]) -> list[np.ndarray]:
    """Undoes the transforms of images of one width, all of them alike but for what their blocks hold and, with a palette, alone: the images stand one below another."""
    heights = [len(x) for x in pixels]
    ends = np.cumsum(heights)
    tops, p = ends - heights, np.concatenate(pixels) if len(pixels) > 1 else pixels[0]
    in_image = np.arange(len(p)) - np.repeat(tops, heights)

    def by_row(images: list[np.ndarray], block: int, wide: int) -> np.ndarray:
        rows = [len(x) for x in images]
        return np.repeat(np.concatenate(images), 1 << block, 1)[np.repeat(np.cumsum(rows) - rows, heights) + (in_image >> block), :wide]

    for at in reversed(range(len(transforms[0]))):
        kind, wide, block, image = transforms[0][at]
        if kind == PALETTE:
            index = (p >> 8) & 255
            if block:
                each = 8 >> block
                index = ((index[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(len(p), -1)[:, :wide]
            p = np.append(image, np.zeros(256 - len(image), np.uint32))[index]
        elif kind == SUBTRACT_GREEN:
            p = without_green(p, True)
        else:
            values, c = by_row([x[at][3] for x in transforms], block, wide), channels(p)
            p = joined(predict_back(c, (values >> 8) & 15, tops) if kind == PREDICTOR else cross_colour(c, channels(values), True))
    return np.split(p, ends[:-1])


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """The pixels (height, width) of lossless images, as alpha, red, green and blue in 32 bits. Those with the same transforms are inverted together."""
    heads, groups = [_opened(x) for x in files], {}
    opened = [(x[0], pixels) for x, pixels in zip(heads, _read_mains([x[1:] for x in heads]), strict=True)]
    for k, (transforms, pixels) in enumerate(opened):
        alike = tuple(x[:3] for x in transforms)
        groups.setdefault((alike, pixels.shape[1], k if any(x[0] == PALETTE for x in transforms) else -1), []).append(k)
    out = [None] * len(files)
    for mine in groups.values():
        for k, image in zip(mine, _inverted([opened[k][0] for k in mine], [opened[k][1] for k in mine]), strict=True):
            out[k] = image
    return out


def decode(data: bytes) -> np.ndarray:
    """The pixels of one image."""
    return decode_all([data])[0]


# writing


class Writer:
    """Values and their numbers of bits, packed at the end."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.v: list[int] = []
        self.n: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.v.append(value)
        self.n.append(size)

    def puts(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values += [np.array(self.v, np.uint64), values.astype(np.uint64)]
        self.sizes += [np.array(self.n, np.int64), sizes]
        self.v, self.n = [], []

    def bytes(self) -> bytes:
        self.puts(np.empty(0, np.uint64), np.empty(0, np.int64))
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        value, size = value[size > 0], size[size > 0]
        stop = np.cumsum(size)
        total, at = int(stop[-1]), stop - size
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((total >> 6) + 2, np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(value << shift, starts)
        over = np.flatnonzero((at & 63) + size > 64)
        out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (total + 7) >> 3]


def write_single(out: Writer, symbol: int) -> None:
    """The code of one symbol below 256, which takes no bits."""
    out.put(1, 2)
    out.put(int(symbol > 1), 1)
    out.put(symbol, 8 if symbol > 1 else 1)


@lru_cache(1)
def _usual() -> tuple[list[int], list[int]]:
    return codes(LENGTHS_OF_LENGTHS).tolist(), LENGTHS_OF_LENGTHS.tolist()


def write_lengths(out: Writer, lengths: np.ndarray, fitted: bool = True) -> None:
    """The lengths of a code, themselves coded: by a code fitted to them, or by the usual one."""
    used = np.flatnonzero(lengths).tolist()
    if not used or len(used) <= 2 and used[-1] < 256:
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    edges = np.append(lengths[1:] != lengths[:-1], True).nonzero()[0]
    runs, last = [], 8
    for v, n in zip(lengths.take(edges).tolist(), np.diff(edges, prepend=-1).tolist(), strict=True):
        runs.append((v, n, v == last))
        last = v or last
    if not fitted:
        head, sizes = _usual_head()
        out.v += head
        out.n += sizes
        for run in runs:
            v, n = _usual_run(*run)
            out.v += v
            out.n += n
        return
    found, extras = [], []
    for run in runs:
        for k, x, bits in _run(*run):
            found.append(k)
            extras.append((x, bits))
    counts = np.bincount(found, minlength=19)
    if np.count_nonzero(counts) == 1:  # a code of lengths needs two symbols to take bits
        counts[17 if counts[0] else 0] += 1
    sizes = code_lengths(counts, 7)
    code, size = codes(sizes).tolist(), sizes.tolist()
    v, n = _head(size)
    out.v += v + [code[s] | x << size[s] for s, (x, _) in zip(found, extras, strict=True)]
    out.n += n + [size[s] + bits for s, (_, bits) in zip(found, extras, strict=True)]


def _head(size: list[int]) -> tuple[list[int], list[int]]:
    """A code of lengths, before lengths in it."""
    order = [size[k] for k in LENGTH_ORDER]
    n = max(4, max(i + 1 for i, s in enumerate(order) if s))
    return [0, n - 4, *order[:n], 0], [1, 4, *[3] * n, 1]


@lru_cache(1)
def _usual_head() -> tuple[list[int], list[int]]:
    return _head(_usual()[1])


@lru_cache(1 << 14)
def _usual_run(v: int, n: int, again: bool) -> tuple[list[int], list[int]]:
    code, size = _usual()
    run = _run(v, n, again)
    return [code[k] | x << size[k] for k, x, _ in run], [size[k] + bits for k, _, bits in run]


def _run(v: int, n: int, again: bool) -> list[tuple[int, int, int]]:
    """(symbol, extra bits, their number) of so many equal lengths; again: the last one above 0 was this."""
    out = []
    while n:
        if n < 3 or v and not again:
            k, again = 1, True
            out.append((v, 0, 0))
        elif v:
            k = min(n, 6)
            out.append((16, k - 3, 2))
        else:
            k = min(n, 138)
            out.append((17, k - 3, 3) if k < 11 else (18, k - 11, 7))
        n -= k
    return out


def copies(pixels: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pixel: how many follow as they do after an earlier one, and how far back that is (1 and 0: none). Found by equal windows."""
    n = len(pixels)
    length, far = np.ones(n, np.int64), np.zeros(n, np.int64)
    if n <= window:
        return length, far
    many = n - window + 1
    plain = window <= 8 and bool(((pixels ^ pixels[0]) & np.uint32(0xFFFF00FF) == 0).all())
    if plain:  # pixels differ in green alone: a window is a number
        green = np.append(((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.uint8), np.zeros(8, np.uint8))
        whole = np.ndarray((many,), "<u8", green, 0, (1,)) & np.uint64((1 << 8 * window) - 1)
        key = whole * np.uint64(0x9E3779B97F4A7C15)
    else:
        key = np.zeros(many, np.uint64)
        for k in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (pixels[k : many + k].astype(np.uint64) + np.uint64(1))
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.sort((key & np.uint64(0xFFFFFFFFFF000000)) | np.arange(many, dtype=np.uint64))  # images have at most 2^24 pixels
    at, same = (order & np.uint64(0xFFFFFF)).view(np.int64), (order[1:] ^ order[:-1]) < np.uint64(1 << 24)
    here, there = at[1:][same], at[:-1][same]
    if plain:
        true = whole[here] == whole[there]
    else:
        true = np.ones(len(here), bool)
        for k in range(window):
            true &= pixels[here + k] == pixels[there + k]
    far[here[true]] = here[true] - there[true]
    back = far[:many]
    place = np.arange(many)
    stops = np.where(np.append(back[1:] != back[:-1], True), place, many)  # where a run of equal distances ends
    match = back.nonzero()[0]
    length[match] = np.minimum((np.minimum.accumulate(stops[::-1])[::-1] - place).take(match) + window, LONGEST)
    return length, far


def tokens(length: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Where tokens begin, if each copy that can be taken is: goes from copy to copy."""
    starts = np.flatnonzero(far)
    after = memoryview(np.searchsorted(starts, starts + length[starts]))  # of each copy: the next one that it doesn't cover
    taken, k = [], 0
    while k < len(starts):
        taken.append(k)
        k = after[k]
    starts = starts[taken]
    covered = np.zeros(len(length) + 1, np.int8)
    covered[starts + 1] += 1
    covered[starts + length[starts]] -= 1
    return np.flatnonzero(covered[:-1].cumsum(dtype=np.int8) == 0)


def write_image(out: Writer, pixels: np.ndarray, width: int, cache: int = 0, window: int = 0, main: bool = False, groups: np.ndarray | None = None, block: int = 2, fitted: bool = True) -> None:
    """An entropy-coded image. window: pixels that a copy has at least, 0 for no copies. groups: one for each block, of the main image."""
    out.put(int(cache > 0), 1)
    if cache:
        out.put(cache, 4)
    n, group = len(pixels), None
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            out.put(block - 2, 3)
            write_image(out, (groups.astype(np.uint32) << 8).ravel(), groups.shape[1])
            group = spread(groups, block, -(-n // width), width).ravel()[:n].astype(np.int64)
    length, far = copies(pixels, window) if window else (np.ones(n, np.int64), np.zeros(n, np.int64))
    if far.any():
        walk = tokens(length, far)
        far, length, p = far.take(walk), length.take(walk), pixels.take(walk)
    else:
        walk, p = np.arange(n), pixels
    copy, literal = np.flatnonzero(far), far == 0
    green = ((p >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if cache:
        slot = (pixels * np.uint32(CACHE_HASH)) >> np.uint32(32 - cache)
        order = np.argsort(slot, kind="stable")
        before = np.full(n, -1)
        same = slot[order[1:]] == slot[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        known = np.where(before >= 0, pixels[before], 0) == pixels  # the cache begins with zeros
        hit = known[walk] & literal
        green[hit] = 280 + slot[walk[hit]]
        literal &= ~hit
    if len(copy):
        s, length_bits, length_extra = prefixed(length[copy])
        green[copy] = 256 + s
        d, numbers = far[copy], near_numbers(width)
        short = np.where(d < len(numbers), numbers[np.minimum(d, len(numbers) - 1)], 0)
        far_sym, far_bits, far_extra = prefixed(np.where(short > 0, short, d + 120))
    literal = np.flatnonzero(literal)
    value, size = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)

    def add(rows: np.ndarray, v: np.ndarray, bits: np.ndarray) -> None:
        value[rows] |= v.astype(np.uint64) << size[rows].astype(np.uint64)
        size[rows] += bits

    def coded(rows: np.ndarray, symbols: np.ndarray, alphabet: int) -> None:
        """Writes the code of these symbols, and adds their bits to these rows' tokens."""
        if not len(symbols) or symbols[0] < 256 and (symbols == symbols[0]).all():
            write_single(out, int(symbols[0]) if len(symbols) else 0)
            return
        lengths = code_lengths(np.bincount(symbols, minlength=alphabet))
        write_lengths(out, lengths, fitted)
        if np.count_nonzero(lengths) > 1:
            add(rows, codes(lengths)[symbols], lengths[symbols])

    for g in range(1 if groups is None else int(groups.max()) + 1):
        # rows of this group: all tokens, literals, copies
        every, plain, far_off = (slice(None), literal, np.arange(len(copy))) if groups is None else (np.flatnonzero(group[walk] == g), literal[group[walk[literal]] == g], np.flatnonzero(group[walk[copy]] == g))
        coded(every, green[every], 280 + (1 << cache if cache else 0))
        for shift in (16, 0, 24):
            coded(plain, ((p[plain] >> np.uint32(shift)) & np.uint32(255)).astype(np.int64), 256)
        if len(far_off):
            add(copy[far_off], length_extra[far_off], length_bits[far_off])
            coded(copy[far_off], far_sym[far_off], 40)
            add(copy[far_off], far_extra[far_off], far_bits[far_off])
        else:
            write_single(out, 0)
    out.puts(value, size)


def encode(pixels: np.ndarray, transforms: tuple = (), cache: int = 0, window: int = 0, groups: np.ndarray | None = None, block: int = 2, fitted: bool = True) -> bytes:
    """A lossless image of pixels (height, width). transforms in the order of writing:
    (PREDICTOR, bits, modes by block), (CROSS_COLOUR, bits, factors by block), (SUBTRACT_GREEN,), (PALETTE,)."""
    height, width = pixels.shape
    out = _begun(height, width)
    for kind, *more in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == PALETTE:
            table, index = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            out.put(len(table) - 1, 8)
            write_image(out, joined(np.diff(channels(table), axis=0, prepend=0)), len(table))
            index, packed = index.reshape(height, width).astype(np.uint32), palette_bits(len(table))
            if packed:
                index = np.pad(index, ((0, 0), (0, -width % (1 << packed)))).reshape(height, -1, 1 << packed)
                index = (index << (np.arange(1 << packed, dtype=np.uint32) * (8 >> packed))).sum(2, dtype=np.uint32)
            pixels, width = OPAQUE | index << np.uint32(8), index.shape[1]
            continue
        if kind == SUBTRACT_GREEN:
            pixels = without_green(pixels, False)
            continue
        c, (bits, image) = channels(pixels), more
        out.put(bits - 2, 3)
        if kind == PREDICTOR:
            write_image(out, OPAQUE | image.astype(np.uint32).ravel() << np.uint32(8), image.shape[1])
            c = predict_residuals(c, spread(image, bits, height, width))
        else:
            write_image(out, image.astype(np.uint32).ravel(), image.shape[1])
            c = cross_colour(c, channels(spread(image.astype(np.uint32), bits, height, width)), False)
        pixels = joined(c)
    out.put(0, 1)
    write_image(out, pixels.ravel().astype(np.uint32), width, cache, window, True, groups, block, fitted)
    return _file(out.bytes())


def _begun(height: int, width: int) -> Writer:
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    return out


def _file(packed: bytes) -> bytes:
    data = b"\x2f" + packed
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# payloads


def layout_of(payload: bytes) -> str:
    """Few different bytes are packed by a palette. One row of pixels leaves the predictor no choice, so it is grey; all else is in colour, with every transform of that layout."""
    if len(set(payload)) <= 16:
        return "palette"
    return "colour" if len(payload) > ROW else "grey"


def store(payload: bytes, layout: str | None = None) -> bytes:
    """A payload (a positive multiple of ROW bytes) as images of at most TILE bytes, one after another."""
    return store_all([payload], layout)[0]


def store_all(payloads: list[bytes], layout: str | None = None) -> list[bytes]:
    """The media of payloads; each is what it is alone."""
    out, tiles, size = [[] for _ in payloads], [], 0

    def flush() -> None:
        for (_, put), data in zip(tiles, _colours([t for t, _ in tiles]) if tiles else [], strict=True):
            put(data)
        tiles.clear()

    for media, payload in zip(out, payloads, strict=True):
        kind = layout or layout_of(payload)
        for k, at in enumerate(range(0, len(payload), TILE)):
            tile = np.frombuffer(payload, np.uint8, min(TILE, len(payload) - at), at)
            if kind != "colour":
                media.append(encode(grey(tile), ((PALETTE if kind == "palette" else SUBTRACT_GREEN,),), window=WINDOW, fitted=False))
                continue
            media.append(b"")
            tiles.append((tile, partial(media.__setitem__, k)))
            size += len(tile)
            if size >= TOGETHER or len(tiles) == MANY:
                flush()
                size = 0
    flush()
    return [b"".join(media) for media in out]


def grey(samples: np.ndarray) -> np.ndarray:
    return OPAQUE | samples.astype(np.uint32).reshape(-1, ROW) * np.uint32(0x010101)


@lru_cache(1)
def _information() -> np.ndarray:
    """By a count: its logarithm to the base 2, times 1024, as a whole number, so that sums don't depend on their order."""
    return np.rint(np.log2(np.maximum(np.arange(TILE // 4 + 1), 1)) * 1024).astype(np.int32)


def _costs(residuals: np.ndarray, image: np.ndarray, pixels: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """By block, of images as wide as one: the information of its values among those of its whole image. image: of each row; pixels: of each image; starts: first rows of blocks."""
    at = residuals + (image[:, None, None] * 1024 + np.arange(0, 1024, 256))
    bits = _information()
    each = (np.repeat(bits.take(pixels), 1024) - bits.take(np.bincount(at.ravel(), minlength=1024 * len(pixels)))).take(at)
    return np.add.reduceat(each.reshape(len(at), -1).sum(1, dtype=np.int64), starts)


#: Predictors and sets of factors that a block has the choice of, and the side of blocks as a power of two.
PREDICTORS, FACTORS, BLOCK = (0, 2, 9), (OPAQUE, OPAQUE | 0x080810), 4


def _colours(tiles: list[np.ndarray]) -> list[bytes]:
    """Four bytes a pixel. Each block of pixels takes the predictor of least cost, and the factors of least cost. The images stand one below another."""
    width = ROW // 4
    heights = np.array([len(t) // ROW for t in tiles])
    pixels = np.concatenate(tiles).view(">u4").astype(np.uint32).reshape(-1, width)
    ends, blocks = np.cumsum(heights), -(-heights >> BLOCK)
    tops, image = ends - heights, np.repeat(np.arange(len(tiles)), heights)
    last = np.cumsum(blocks)
    nth = np.arange(int(last[-1])) - np.repeat(last - blocks, blocks)
    starts = np.repeat(tops, blocks) + (nth << BLOCK)
    block = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(pixels)))  # of each row
    c, counts = channels(pixels), heights * width

    def least(tried: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        best = np.argmin([_costs(x, image, counts, starts) for x in tried], 0)
        out = tried[0].copy()
        for k, x in enumerate(tried[1:], 1):
            rows = (best == k)[block]
            out[rows] = x[rows]
        return best, out

    y, x = np.divmod(np.arange(pixels.size), width)
    near = _neighbours(c, y, x)
    residuals = []
    for mode in PREDICTORS:
        r = (c - _guess(mode, *near).reshape(c.shape)) & 255
        r[:, 0] = (c[:, 0] - near[1].reshape(c.shape)[:, 0]) & 255
        r[tops] = np.diff(c[tops], axis=1, prepend=np.array([255, 0, 0, 0], np.int16)[None, None].repeat(len(tops), 0)) & 255
        residuals.append(r)
    modes, left = least(residuals)
    modes = np.array(PREDICTORS, np.uint32)[modes]
    crossed = [left] + [cross_colour(left, np.broadcast_to(channels(np.array(f, np.uint32)), left.shape), False) & 255 for f in FACTORS[1:]]
    factors, crossed = least(crossed)
    factors = np.array(FACTORS, np.uint32)[factors]
    modes, pixels, heads = OPAQUE | modes << np.uint32(8), joined(crossed), []
    for k, height in enumerate(heights.tolist()):
        mine, file = slice(last[k] - blocks[k], last[k]), _begun(height, width)
        for kind, values in ((PREDICTOR, modes[mine]), (CROSS_COLOUR, factors[mine])):
            file.put(1, 1)
            file.put(kind, 2)
            file.put(BLOCK - 2, 3)
            value, size = _column(values.astype(np.uint32).tobytes())
            file.v += value
            file.n += size
        file.put(0, 1)
        heads.append((file.v, file.n))
    return [_file(x) for x in write_sides(heads, pixels.ravel(), counts, width)]


#: Bits of the cache and pixels that a copy has at least, of images that are written side by side; the most of such images, and of their pixels one.
CACHE, COPY, MANY, AREA = 8, 3, 1 << 11, 1 << 18


def write_sides(heads: list[tuple[list[int], list[int]]], pixels: np.ndarray, counts: np.ndarray, width: int) -> list[bytes]:
    """Main images one after another, as `write_image` writes each, behind heads (values, sizes): their bits, packed."""
    n, many = len(pixels), len(counts)
    image, begins = np.arange(many).repeat(counts), np.cumsum(counts) - counts
    length, far = _copies_aside(pixels, image, counts, begins)
    walk = tokens(length, far) if far.any() else np.arange(n)
    far, length, p, of = far.take(walk), length.take(walk), pixels.take(walk), image.take(walk)
    copy = far.nonzero()[0]
    symbol = ((p >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    slot = ((pixels * np.uint32(CACHE_HASH)) >> np.uint32(32 - CACHE)).astype(np.int64)
    order = np.sort((image << CACHE | slot) << 24 | np.arange(n))
    group, order = order >> 24, order & (1 << 24) - 1
    known = pixels == 0  # the cache begins with zeros
    same = group[1:] == group[:-1]
    here, there = order[1:][same], order[:-1][same]
    known[here] = pixels[there] == pixels[here]
    hit = known[walk] & (far == 0)
    symbol[hit] = 280 + slot[walk[hit]]
    s, length_bits, length_extra = prefixed(length[copy])
    symbol[copy] = 256 + s
    d, numbers = far[copy], near_numbers(width)
    short = np.where(d < len(numbers), numbers[np.minimum(d, len(numbers) - 1)], 0)
    far_symbol, far_bits, far_extra = prefixed(np.where(short > 0, short, d + 120))
    literal = (~hit & (far == 0)).nonzero()[0]
    # five codes an image
    alphabets = np.array([280 + (1 << CACHE), 256, 256, 256, 40])
    into = np.cumsum(alphabets) - alphabets
    whole, base = int(alphabets.sum()), of * int(alphabets.sum())
    at = [base + symbol, *(base[literal] + into[k] + ((p[literal] >> np.uint32(shift)) & np.uint32(255)).astype(np.int64) for k, shift in ((1, 16), (2, 0), (3, 24))), base[copy] + into[4] + far_symbol]
    found = np.bincount(np.concatenate(at), minlength=many * whole)
    row_at = (np.arange(many)[:, None] * whole + into).ravel()
    code, size = _codes_aside(found, row_at)
    value, bits = code.take(at[0]).astype(np.uint64), size.take(at[0])

    def add(rows: np.ndarray, v: np.ndarray, k: np.ndarray) -> None:
        value[rows] |= v.astype(np.uint64) << bits[rows].astype(np.uint64)
        bits[rows] += k

    for x in at[1:4]:
        add(literal, code.take(x), size.take(x))
    add(copy, length_extra, length_bits)
    add(copy, code.take(at[4]), size.take(at[4]))
    add(copy, far_extra, far_bits)
    head_v, head_n = (np.concatenate([np.array(x[k] + more, np.uint64) for x in heads]) for k, more in ((0, [1, CACHE, 0]), (1, [1, 4, 1])))
    head_count = np.array([len(x[0]) + 3 for x in heads])
    code_v, code_n, code_count = _lengths_aside(found, size, row_at, np.tile(alphabets, many))
    sections = np.stack([head_count, code_count.reshape(many, 5).sum(1), np.bincount(of, minlength=many)], 1)
    starts = (np.cumsum(sections) - sections.ravel()).reshape(many, 3)
    v, k = np.zeros(int(sections.sum()), np.uint64), np.zeros(int(sections.sum()), np.int64)
    for j, (x, y) in enumerate(((head_v, head_n), (code_v, code_n), (value, bits))):
        place = (starts[:, j] - (np.cumsum(sections[:, j]) - sections[:, j])).repeat(sections[:, j]) + np.arange(len(x))
        v[place], k[place] = x, y
    return _packed(v, k, sections.sum(1))


def _copies_aside(pixels: np.ndarray, image: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`copies` within each image."""
    n = len(pixels)
    length, far = np.ones(n, np.int64), np.zeros(n, np.int64)
    inside = np.arange(n) - begins.repeat(counts)
    first = (inside <= counts.repeat(counts) - COPY).nonzero()[0]
    key = np.zeros(max(n - COPY + 1, 0), np.uint64)
    for k in range(COPY):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (pixels[k : len(key) + k].astype(np.uint64) + np.uint64(1))
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    order = np.sort(image.take(first).astype(np.uint64) << np.uint64(53) | (key.take(first) >> np.uint64(29)) << np.uint64(18) | inside.take(first).astype(np.uint64))
    same = (order[1:] ^ order[:-1]) < np.uint64(AREA)
    at = begins.take((order >> np.uint64(53)).view(np.int64)) + (order & np.uint64(AREA - 1)).view(np.int64)
    here, there = at[1:][same], at[:-1][same]
    true = np.ones(len(here), bool)
    for k in range(COPY):
        true &= pixels.take(here + k) == pixels.take(there + k)
    far[here[true]] = here[true] - there[true]
    place = np.arange(n)
    stops = np.where(np.append(far[1:] != far[:-1], True), place, n)
    match = far.nonzero()[0]
    length[match] = np.minimum((np.minimum.accumulate(stops[::-1])[::-1] - place).take(match) + COPY, LONGEST)
    return length, far


def _codes_aside(found: np.ndarray, row_at: np.ndarray, most: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """`codes` and `code_lengths` of counts, where rows begin at these places; a symbol that stands alone takes no bits."""
    place = found.nonzero()[0]
    row, rows = np.searchsorted(row_at, place, "right") - 1, len(row_at)
    order = np.sort(row << 40 | ((1 << 20) - found.take(place)) << 12 | place - row_at.take(row))  # frequent symbols first
    row, n, place = order >> 40, (1 << 20) - (order >> 12 & (1 << 28) - 1), (order & 4095) + row_at.take(order >> 40)
    used = np.bincount(row, minlength=rows)
    weight, total, size, open_ = n.copy(), np.bincount(row, n, rows).astype(np.int64), np.zeros(len(n), np.int64), np.ones(rows, bool)
    while True:
        mine = open_.take(row).nonzero()[0]
        size[mine] = np.minimum(np.maximum(np.ceil(np.log2(total.take(row.take(mine)) / weight.take(mine))), 1).astype(np.int64), most)
        left = (1 << most) - np.bincount(row, 1 << (most - size), rows).astype(np.int64)
        open_ = left < 0
        if not open_.any():
            break
        mine = open_.take(row)
        weight[mine] += ((total >> 12) + 1).take(row[mine])
        total = np.where(open_, np.bincount(row, weight, rows).astype(np.int64), total)
    left[used < 2] = 0
    first, live, k = np.cumsum(used) - used, left.nonzero()[0], 0
    while len(live):
        at = first.take(live) + k
        now, have = size.take(at), left.take(live)
        room = 1 << (most - now)
        ok = (room <= have) & (now > 1)
        size[at] = now - ok
        have = have - room * ok
        left[live] = have
        k += 1
        live = live[(have > 0) & (used.take(live) > k)]
    while left.any():  # the longest codes always fit into what is left
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, row, size)
        mine = ((size == longest.take(row)) & (left > 0).take(row)).nonzero()[0]
        which = row.take(mine)
        many = np.bincount(which, minlength=rows)
        nth = np.arange(len(mine)) - (np.cumsum(many) - many).take(which)
        take = np.minimum(many, left >> (most - longest))
        size[mine] -= nth < take.take(which)
        left -= take << (most - longest)
    order = np.argsort(row << 24 | size << 16 | place - row_at.take(row))
    row, size, place = row.take(order), size.take(order), place.take(order)
    share = 1 << (most - size)
    before = np.cumsum(share) - share
    code, out = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    alone = used.take(row) < 2
    code[place] = np.where(alone, 0, reversal(most).take((before - before.take(first.take(row))) & (1 << most) - 1))
    out[place] = np.where(alone, 0, size)
    return code, out


def _lengths_aside(found: np.ndarray, size: np.ndarray, row_at: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `write_lengths` writes of each row with the usual code, and how many values that are."""
    used = np.add.reduceat(found > 0, row_at, dtype=np.int64)
    values, sizes, counts = [], [], np.zeros(len(row_at), np.int64)
    # runs of equal lengths
    edge = np.append(size[1:] != size[:-1], True)
    edge[row_at[1:] - 1] = True
    stop = edge.nonzero()[0]
    n, v = np.diff(stop, prepend=-1), size.take(stop)
    row = np.searchsorted(row_at, stop, "right") - 1
    one, two = (np.append([0] * k, v[:-k]) for k in (1, 2))
    has_one, has_two = (np.append([False] * k, row[k:] == row[:-k]) for k in (1, 2))
    last = np.where(has_one & (one > 0), one, np.where(has_two & (two > 0), two, 8))
    kinds, kind = np.unique((v << 12 | n) << 1 | (v == last), return_inverse=True)
    parts = [_usual_run(x >> 13, x >> 1 & 4095, bool(x & 1)) for x in kinds.tolist()]
    # rows of one or two symbols are written another way
    odd = (used <= 2).nonzero()[0]
    keep = (used > 2).take(row)
    kind, row = kind[keep], row[keep]
    head_v, head_n = _usual_head()
    for r in odd.tolist():
        out, mine = Writer(), found[row_at[r] : row_at[r] + alphabets[r]]
        symbols = mine.nonzero()[0]
        if len(symbols) < 2 and (not len(symbols) or symbols[0] < 256):
            write_single(out, int(symbols[0]) if len(symbols) else 0)
        else:
            write_lengths(out, (mine > 0).astype(np.int64), False)
        parts.append((out.v, out.n))
    parts.append((head_v, head_n))
    many = np.array([len(x[0]) for x in parts])
    flat_v, flat_n = (np.array([y for x in parts for y in x[k]], np.int64) for k in (0, 1))
    usual = (used > 2).nonzero()[0]
    # a part each: heads of usual rows, their runs, odd rows, by row
    part = np.concatenate([np.full(len(usual), len(parts) - 1), kind, len(kinds) + np.arange(len(odd))])
    where = np.concatenate([usual, row, odd])
    order = where.argsort(kind="stable")
    part, where = part[order], where[order]
    n = many.take(part)
    at = (np.cumsum(many) - many).take(part).repeat(n) + np.arange(int(n.sum())) - (np.cumsum(n) - n).repeat(n)
    return flat_v.take(at).astype(np.uint64), flat_n.take(at), np.bincount(where, n, len(row_at)).astype(np.int64)


def _packed(value: np.ndarray, size: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bits of so many values for each image, as bytes."""
    total = np.add.reduceat(size, np.cumsum(counts) - counts)
    words = (total + 63) >> 6
    first = np.cumsum(words) - words
    shift = (first << 6) - (np.cumsum(total) - total)
    at = np.cumsum(size) - size + shift.repeat(counts)
    some = size > 0
    value, size, at = value[some], size[some], at[some]
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[starts]] = np.bitwise_or.reduceat(value << bit, starts)
    over = np.flatnonzero((at & 63) + size > 64)
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - bit[over])
    data = out.tobytes()
    return [data[8 * a : 8 * a + ((n + 7) >> 3)] for a, n in zip(first.tolist(), total.tolist(), strict=True)]


@lru_cache(1 << 12)
def _column(pixels: bytes) -> tuple[list[int], list[int]]:
    """Values and sizes of an entropy-coded image one pixel wide."""
    out = Writer()
    write_image(out, np.frombuffer(pixels, np.uint32), 1)
    out.puts(np.empty(0, np.uint64), np.empty(0, np.int64))
    return np.concatenate(out.values).tolist(), np.concatenate(out.sizes).tolist()


def load(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of all images of a medium."""
    return load_all([media])[0]


def load_all(media: list[bytes]) -> list[list[np.ndarray]]:
    """The same of many."""
    files = []
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            size = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
            files.append((k, data[at : at + size]))
            at += size
    out = [[] for _ in media]
    for (k, _), image in zip(files, decode_all([x for _, x in files]), strict=True):
        out[k].append(image)
    return out


def samples(image: np.ndarray) -> bytes:
    """The bytes that an image of a payload stands for, by its width."""
    if image.shape[1] == ROW:
        return ((image >> 8) & 255).astype(np.uint8).tobytes()
    return image.astype(">u4").tobytes()


def feature(payload: np.ndarray) -> str:
    """Which of 64 equal stretches lie above the mean of all samples, as hex digits, and that mean."""
    parts = payload.reshape(64, -1).sum(1, dtype=np.int64)
    above = np.packbits(parts * 64 > parts.sum()).tobytes().hex()
    return f"{above}:{int(parts.sum()) // len(payload)}"


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def to_media(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Replaces the text by its medium and its number of bytes."""
    keep = [c for c in docs.columns if c not in (text, media, n_bytes)]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(n_bytes, T.LongType(), False), T.StructField(media, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            payloads, sizes = [padded(x) for x in texts], [len((x or "").encode()) for x in texts]
            each = list(dict.fromkeys(payloads))
            done = dict(zip(each, store_all(each), strict=True))
            out = [done[x] for x in payloads]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], [*keep, n_bytes, media])

    return map_rows(docs, run, schema)


def _together(media: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Runs of media of some TOGETHER bytes."""
    run, size = [], 0
    for x in media:
        run.append(x)
        size += len(x or b"")
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def from_media(stored: DataFrame, media: str = "media", payload: str = "payload", mark: str = "feature") -> DataFrame:
    """Adds what the decoded images hold, and a feature of it."""
    keep = [c for c in stored.columns if c not in (payload, mark)]
    schema = T.StructType([*(stored.schema[c] for c in keep), T.StructField(payload, T.BinaryType()), T.StructField(mark, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in _together(batch.column(media).to_pylist()):
                out += [None if x is None else b"".join(map(samples, images)) for x, images in zip(some, load_all([x or b"" for x in some]), strict=True)]
            marks = [feature(np.frombuffer(x, np.uint8)) if x else None for x in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary()), pa.array(marks, pa.string())], [*keep, payload, mark])

    return map_rows(stored, run, schema)
