"""Importance resampling against features made as strings, on odd texts and at every width of a stretch."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def texts():
    r = random.Random(5)
    odd = [None, "", " ", "...", "A", "İÉ ß", "a" * 300 + " b " + "c" * 49, "\x00\x7f`{", "x" * 90_000, "中" * 40 + " y z"]
    return odd + ["".join(r.choice("aB9.- é中\n") for _ in range(r.randint(0, 300))) for _ in range(120)] + [" ".join("".join(r.choice("abÀZ") for _ in range(r.randint(1, 70))) for _ in range(900))]


@pytest.mark.parametrize("stretch", [48, 1000, 1 << 18])
def test_features_of_stretches(monkeypatch, stretch):
    monkeypatch.setattr(importance, "STRETCH", stretch)
    column = pa.array(["x y", *texts()]).slice(1)  # an array that begins inside its buffers
    got = [np.zeros(10000, np.int64) for _ in column]
    for data, ends, first, carried in importance.stretches(column):
        for found, of in importance.buckets(data, ends, carried):
            for i in range(len(ends)):
                got[first + i] += np.bincount(found[of == i], minlength=10000)
    for text, counts in zip(texts(), got, strict=True):
        assert {k: int(counts[k]) for k in np.flatnonzero(counts)} == features(text)[1]


def brute(docs, bench):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in bench:
        t.update(features(x)[1])
    S, W = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (W + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        n, f = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] * c for b, c in f.items())
        rows.append((i, n, sum(f.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3]))
    places = {}
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        places.setdefault(r, []).append(k)
    return sorted(((r[0], *r[2:], places[r].pop() if places.get(r) else None) for r in rows), key=str)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(7)
    v = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(r.choice(v) for _ in range(r.randint(0, 60)))) for i in range(300)] + list(enumerate(texts(), 400)) + [(None, "a b " * 15), (7, "w1 w2 " * 12), (7, "w1 w2 " * 12), (8, None)]
    bench = [" ".join(r.choice(v[:9]) for _ in range(40)) for _ in range(12)] + [None, ""]
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, rank string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, queries.op11_importance(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute(docs, bench)


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "kept", 5), (2, None, None, 6)], "doc_id long, text string, `a.b` string, weight int")
    out = importance.draw(importance.weigh(docs, docs.limit(0)))
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((r["doc_id"], r["a.b"], r["n_features"], r["rank"]) for r in out.collect()) == [(1, "kept", 3, None), (2, None, 0, None)]
    assert importance.draw(importance.weigh(docs.limit(0), docs)).count() == 0
