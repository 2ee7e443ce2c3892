"""The lossless WebP codec: every part of the format against a reader that takes one bit after another."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from foliant.llm import queries, webp


class Reader:
    """A plain reader of the format, bit by bit and pixel by pixel, sharing nothing with the codec."""

    def __init__(self, data):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").tolist()
        self.at = 0

    def read(self, n):
        out = sum(b << i for i, b in enumerate(self.bits[self.at : self.at + n]))
        self.at += n
        return out

    def code(self, alphabet):
        lengths = [0] * alphabet
        if self.read(1):
            n, wide = self.read(1) + 1, self.read(1)
            for k in [self.read(8 if wide else 1)] + [self.read(8) for _ in range(n - 1)]:
                lengths[k] = 1
        else:
            order, small = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15], [0] * 19
            for k in order[: self.read(4) + 4]:
                small[k] = self.read(3)
            most = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
            table, i, last = self.table(small), 0, 8
            while i < alphabet and most:
                most -= 1
                k = self.symbol(table)
                v, n = (k, 1) if k < 16 else (last, 3 + self.read(2)) if k == 16 else (0, 3 + self.read(3)) if k == 17 else (0, 11 + self.read(7))
                last = v or last
                lengths[i : i + n] = [v] * n
                i += n
        return self.table(lengths)

    def table(self, lengths):
        used = sorted((n, k) for k, n in enumerate(lengths) if n)
        if len(used) < 2:
            return used[0][1] if used else 0
        out, value, size = {}, 0, used[0][0]
        for n, k in used:
            value <<= n - size
            out[n, value], size = k, n
            value += 1
        return out

    def symbol(self, table):
        if isinstance(table, int):
            return table
        n = value = 0
        while (n, value) not in table:
            value, n = value * 2 + self.read(1), n + 1
        return table[n, value]

    def number(self, k):
        if k < 4:
            return k + 1
        extra = (k - 2) // 2
        return (2 + k % 2 << extra) + self.read(extra) + 1

    def image(self, width, height, main):
        cache = self.read(4) if self.read(1) else 0
        block, groups = 0, None
        if main and self.read(1):
            block = self.read(3) + 2
            groups = [(p >> 8) & 0xFFFF for p in self.image(-(-width >> block), -(-height >> block), False)]
        codes = [[self.code(n) for n in (280 + (cache and 2**cache), 256, 256, 256, 40)] for _ in range(max(groups or [0]) + 1)]
        near, out, slots = {}, [], [0] * 2**cache
        for k, (x, y) in enumerate(webp.NEAR):
            near[k + 1] = max(1, x + y * width)
        while len(out) < width * height:
            g = codes[groups[(len(out) // width >> block) * -(-width >> block) + (len(out) % width >> block)] if groups else 0]
            s = self.symbol(g[0])
            if s < 256:
                red, blue, alpha = (self.symbol(t) for t in g[1:4])
                new = [alpha << 24 | red << 16 | s << 8 | blue]
            elif s < 280:
                n, d = self.number(s - 256), self.number(self.symbol(g[4]))
                d, new = near.get(d, d - 120), []
                for _ in range(n):
                    new.append((out + new)[-d])
            else:
                new = [slots[s - 280]]
            for p in new:
                slots[(p * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache if cache else 0] = p
            out += new
        return out


def split(p):
    return [p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255]


def guess(mode, a, b, c, d):
    """From left, above, above right and above left."""
    half = lambda x, y: [(i + j) // 2 for i, j in zip(x, y, strict=True)]
    clip = lambda v: min(255, max(0, v))
    if mode == 11:
        p = [i + j - k for i, j, k in zip(a, b, d, strict=True)]
        return a if sum(abs(i - j) for i, j in zip(p, a, strict=True)) < sum(abs(i - j) for i, j in zip(p, b, strict=True)) else b
    if mode == 12:
        return [clip(i + j - k) for i, j, k in zip(a, b, d, strict=True)]
    if mode == 13:
        return [clip(m + int((m - k) / 2)) for m, k in zip(half(a, b), d, strict=True)]
    return {1: a, 2: b, 3: c, 4: d, 5: half(half(a, c), b), 6: half(a, d), 7: half(a, b), 8: half(d, b), 9: half(b, c), 10: half(half(a, d), half(b, c))}.get(mode, [255, 0, 0, 0])


def plain(data):
    """The rows of pixels of a file."""
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and int.from_bytes(data[4:8], "little") == len(data) - 8
    r = Reader(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    assert r.read(8) == 0x2F
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(4)
    steps, wide = [], width
    while r.read(1):
        kind = r.read(2)
        if kind < 2:
            bits = r.read(3) + 2
            steps.append((kind, wide, bits, r.image(-(-wide >> bits), -(-height >> bits), False)))
        elif kind == 2:
            steps.append((kind, wide, 0, None))
        else:
            n, table, last = r.read(8) + 1, [], [0] * 4
            for p in r.image(n, 1, False):
                last = [(i + j) & 255 for i, j in zip(last, split(p), strict=True)]
                table.append(int.from_bytes(bytes(last), "big"))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, wide, bits, table))
            wide = -(-wide >> bits)
    p = r.image(wide, height, True)
    for kind, full, bits, more in reversed(steps):
        new = []
        for i in range(full * height):
            y, x = divmod(i, full)
            if kind == 3:
                k = (p[y * wide + (x >> bits)] >> 8 & 255) >> (x % 2**bits) * (8 >> bits) & (1 << (8 >> bits)) - 1
                new.append(more[k] if k < len(more) else 0)
                continue
            c = split(p[i])
            if kind == 2:
                c = [c[0], c[1] + c[2] & 255, c[2], c[3] + c[2] & 255]
            elif kind == 1:
                f = split(more[(y >> bits) * -(-full >> bits) + (x >> bits)])
                sign = lambda v: v - 256 if v > 127 else v
                red = c[1] + (sign(f[3]) * sign(c[2]) >> 5) & 255
                c = [c[0], red, c[2], c[3] + (sign(f[2]) * sign(c[2]) >> 5) + (sign(f[1]) * sign(red) >> 5) & 255]
            else:
                at = lambda j: split(new[j])
                if not x and not y:
                    g = [255, 0, 0, 0]
                elif not y:
                    g = at(i - 1)
                elif not x:
                    g = at(i - full)
                else:
                    g = guess(more[(y >> bits) * -(-full >> bits) + (x >> bits)] >> 8 & 15, at(i - 1), at(i - full), at(i - full + 1), at(i - full - 1))
                c = [(u + v) & 255 for u, v in zip(c, g, strict=True)]
            new.append(int.from_bytes(bytes(c), "big"))
        p, wide = new, full
    return np.array(p, np.uint32).reshape(height, width)


def test_near_places():
    """Fixed values of the format: the first twelve and the last places."""
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(webp.NEAR) == 120 and webp.NEAR[34:40] == [(0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


@pytest.mark.parametrize("size", [(1, 1), (1, 40), (17, 1), (9, 7), (21, 16)])
@pytest.mark.parametrize("colours", [1, 2, 4, 16, 90, 10**6])
def test_every_part_of_the_format(size, colours):
    r = np.random.default_rng(colours)
    h, w = size
    noise = r.integers(0, 2**32, colours, dtype=np.uint32)[r.integers(0, colours, size)]
    few = -(-h >> 2), -(-w >> 2)
    modes, factors, groups = r.integers(0, 16, few), r.integers(0, 2**32, few, dtype=np.uint32), r.integers(0, 3, few)
    for p in (noise, np.resize(noise.ravel()[:23], size)):
        kinds = [{}, {"cache": 1, "window": 2}, {"cache": 7, "window": 3}, {"window": 1}, {"groups": groups}, {"groups": groups, "window": 2, "cache": 3}, {"transforms": ((webp.SUBTRACT_GREEN,),)}]
        kinds += [{"transforms": ((webp.PREDICTOR, 2, modes),), "window": 2}, {"transforms": ((webp.CROSS_COLOUR, 2, factors),)}]
        kinds += [{"transforms": ((webp.CROSS_COLOUR, 2, factors), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR, 2, modes)), "cache": 4, "groups": groups}]
        if len(np.unique(p)) <= 256:
            narrow = -(-w >> webp.palette_bits(len(np.unique(p))))
            kinds += [{"transforms": ((webp.PALETTE,),), "window": 3}, {"transforms": ((webp.PALETTE,), (webp.PREDICTOR, 2, modes[:, : -(-narrow >> 2)])), "cache": 2}]
        for kind in kinds:
            data = webp.encode(p, **kind)
            assert (plain(data) == p).all() and (webp.decode(data) == p).all(), kind


def test_run_length_codes_and_short_alphabets():
    r = np.random.default_rng(1)
    for counts in ([1] * 280, [5] * 7 + [0] * 273, [0] * 279 + [1], [2**k for k in range(30)] + [0] * 250, r.integers(0, 2, 280), [0] * 100 + [1] * 50 + [0] * 130):
        lengths = webp.code_lengths(np.array(counts))
        assert lengths.max() <= 15 and (np.count_nonzero(lengths) < 2 or (2.0 ** -lengths[lengths > 0]).sum() == 1)
        out = webp.Writer()
        webp.write_lengths(out, lengths)
        assert (webp.read_lengths(webp.Bits(out.bytes()), 280) == lengths).all()
        out = webp.Writer()
        webp.write_lengths(out, lengths, fitted=False)
        assert (webp.read_lengths(webp.Bits(out.bytes()), 280) == lengths).all()
    assert (2.0**-webp.LENGTHS_OF_LENGTHS).sum() == 1
    some = np.array([1, 2, 3, 4, 5, 6, 4095, 4096, 65535])
    assert all((a == b).all() for a, b in zip(webp.prefixed(some), webp.prefixed(np.append(some, 1 << 17)), strict=False) if len(a) == len(b)) and [webp._value(int(k), webp.Bits(int(x).to_bytes(4, "little"))) for k, _, x in zip(*webp.prefixed(some), strict=True)] == some.tolist()


@pytest.mark.parametrize("stretch", [512, 1 << 17])
def test_stretches_and_single_tokens_agree(monkeypatch, stretch):
    monkeypatch.setattr(webp, "STRETCH", stretch)
    text = (" ".join(random.Random(3).choices(["the", "lazy", "dog", "dög", "jumped", "over"], k=3000)) + "x" * 9000).encode()
    for layout in ("grey", "palette", "colour"):
        payload = webp.padded(text.decode())
        media = webp.store(payload, layout)
        assert b"".join(map(webp.samples, webp.load(media))) == payload and len(media) < len(payload)
    monkeypatch.setattr(webp, "_read_array", lambda bits, tables, width, n, cache: webp._read_each(bits, [tables], None, width, n, cache))
    assert b"".join(map(webp.samples, webp.load(media))) == payload


def test_several_images_and_damage(monkeypatch):
    monkeypatch.setattr(webp, "TILE", 1024)
    payload = webp.padded("Straße 中 " * 400)
    media = webp.store(payload, "grey")
    assert len(webp.load(media)) == -(-len(payload) // 1024) and b"".join(map(webp.samples, webp.load(media))) == payload
    whole = webp.store(payload[:1024], "grey")
    for broken in (b"RIFX" + whole[4:], whole[: len(whole) // 2] + bytes(len(whole) - len(whole) // 2)):
        try:
            assert (webp.decode(broken) != webp.decode(whole)).any()
        except ValueError:
            pass


def test_all_payloads_of_several_rows_take_the_predictor():
    """The layout goes by what a payload holds, not by its checksum: texts all have the predictor, the cross-colour transform and the cache."""
    r = random.Random(3)
    for k in range(200):
        payload = webp.padded(" ".join(r.choices("aé中 bcdefghijklmnopqrst", k=60 + k)))
        data = webp.store(payload)
        bits = webp.Bits(data[21:], 32)
        assert webp.layout_of(payload) == "colour" and bits.read(3) == 1 | webp.PREDICTOR << 1 and b"".join(map(webp.samples, webp.load(data))) == payload
    assert webp.layout_of(webp.padded("x" * 9000)) == "palette" and webp.layout_of(bytes(range(64))) == "grey"


def test_images_are_transformed_together(monkeypatch):
    """Predictors are inverted a row of all images at a time, and a medium doesn't depend on those stored with it."""
    r, calls = random.Random(4), []
    payloads = [webp.padded(" ".join(r.choices("aé中 bcdefghijklmnopqrst", k=r.randint(1, 900)))) for _ in range(120)] + [webp.padded("x" * 700), webp.padded("")]
    media = webp.store_all(payloads)
    assert media == [webp.store(p) for p in payloads] and webp.decode_all([]) == []
    one_row = webp.predicted
    monkeypatch.setattr(webp, "predicted", lambda modes, *near: calls.append(len(modes)) or one_row(modes, *near))
    assert [b"".join(map(webp.samples, x)) for x in webp.load_all(media)] == payloads
    assert len(calls) < max(map(len, payloads)) // webp.ROW and sum(calls) > 10 * len(payloads)
    for p, x in zip(payloads[:20], media, strict=False):
        assert (plain(x) == webp.decode(x)).all(), p
    monkeypatch.setattr(webp, "TOGETHER", 2000)
    assert webp.store_all(payloads) == media


def test_images_below_one_another_with_any_modes():
    r, images = np.random.default_rng(8), []
    for k in range(40):
        h = int(r.integers(1, 40))
        p = r.integers(0, 2**32, (h, 16), dtype=np.uint32)
        modes = r.choice([0, 2, 9, 12] if k % 3 == 0 else [0, 2, 3, 4, 8, 9], (-(-h >> 2), 4))
        images.append((p, webp.encode(p, ((webp.PREDICTOR, 2, modes),), cache=4, window=2)))
    assert all((a == b).all() for (a, _), b in zip(images, webp.decode_all([x for _, x in images]), strict=True))


def test_images_are_read_and_written_side_by_side(monkeypatch):
    """Main images of a batch aren't read or written one by one, whatever their codes; pixels and media are those of each alone."""
    r, n = random.Random(5), np.random.default_rng(5)
    texts = [" ".join(r.choices("aé中 bcdefghijklmnopqrst", k=r.randint(30, 900))) for _ in range(150)] + ["ab" * 9000, "".join(map(chr, r.choices(range(32, 127), k=30000)))]
    payloads = [webp.padded(x) for x in texts] + [n.integers(0, 256, 1 << 16, dtype=np.uint8).tobytes()]  # noise: readings of its pieces seldom meet
    media = webp.store_all(payloads)
    images = []
    for k in range(120):
        p = n.integers(0, 1 << (32 if k % 2 else 3), (int(n.integers(1, 60)), int(n.integers(1, 40))), dtype=np.uint32)
        p[: len(p) // 2] = p[len(p) // 2 : len(p) // 2 * 2]
        groups = n.integers(0, 3, (-(-p.shape[0] >> 2), -(-p.shape[1] >> 2))) if k % 5 == 0 else None
        images.append((p, webp.encode(p, cache=(0, 1, 7, 11)[k % 4], window=(0, 2, 3)[k % 3], groups=groups, fitted=k % 7 > 0)))
    alone, calls = [webp.decode(x) for _, x in images], []
    one, write = webp.read_image, webp.write_image
    monkeypatch.setattr(webp, "read_image", lambda bits, width, height, main=False: calls.append(main) or one(bits, width, height, main))
    assert [b"".join(map(webp.samples, x)) for x in webp.load_all(media)] == payloads
    assert sum(calls) < 10
    monkeypatch.setattr(webp, "ENOUGH", 0)
    for piece in (64, 4096):
        monkeypatch.setattr(webp._Sides, "PIECE", piece)
        assert all((a == p).all() and (a == b).all() for (p, _), a, b in zip(images, webp.decode_all([x for _, x in images]), alone, strict=True))
        assert [b"".join(map(webp.samples, webp.load(x))) for x in media[:20]] == payloads[:20]
    for at in (len(media[3]) // 2, len(media[3]) - 1):
        short = media[3][:16] + (at - 20).to_bytes(4, "little") + media[3][20:at]
        with pytest.raises(ValueError):
            webp.decode_all([*media[:3], short, *media[4:9]])
    wide = []
    monkeypatch.setattr(webp, "write_image", lambda out, pixels, *more, **kw: wide.append(len(pixels)) or write(out, pixels, *more, **kw))
    assert webp.store_all(payloads) == media and sum(x > 100 for x in wide) == 1  # that of the payload with a palette
    monkeypatch.setattr(webp, "MANY", 3)
    assert webp.store_all(payloads) == media


def test_query_against_plain_python(spark, tmp_path):
    r = random.Random(9)
    texts = [None, "", "a", "x" * 64, "x" * 65, "é" * 40, "\x00", "ab" * 5000] + [" ".join(r.choices("aé中 bcdefghijklmnopqrst", k=r.randint(1, 300))) for _ in range(400)]
    texts += texts[5:20]
    spark.createDataFrame(list(enumerate(texts)) + [(None, "z")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_webp(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    media = {}
    for x in rows:
        text = ("z" if x["doc_id"] is None else texts[x["doc_id"]] or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = webp.store(payload)
        assert (x["media_bytes"], x["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.setdefault(payload, (x["media_sha256"], x["feature"])) == (x["media_sha256"], x["feature"])
    assert {webp.layout_of(p) for p in media} == {"grey", "palette", "colour"} and all(plain(webp.store(p)).size for p in list(media)[:12])


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "kept", 3), (2, None, None, 4)], "id long, text string, `a.b` string, media int")
    back = webp.from_media(webp.to_media(docs))
    assert back.columns == ["id", "a.b", "n_bytes", "media", "payload", "feature"]
    assert sorted((x["id"], x["a.b"], x["n_bytes"], bytes(x["payload"])) for x in back.collect()) == [(1, "kept", 1, b"a" + bytes(63)), (2, None, 0, bytes(64))]
    assert webp.from_media(webp.to_media(docs.limit(0))).count() == 0
    none = spark.createDataFrame([(None,)], "media binary")
    assert [tuple(x) for x in webp.from_media(none).collect()] == [(None, None, None)]
