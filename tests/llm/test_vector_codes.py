"""Product codes: bounds and groups change nothing about plain Lloyd's rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from foliant.llm import queries, vector_codes

KINDS = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """Plain Python over (id, vector, label): every part against every entry."""
    kept = sorted((r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * c) for c in r[1]]))
    ints = [[math.floor(1024 * c) for c in r[1]] for r in kept]
    w = len(ints[0]) // 4
    parts = [[v[p * w : (p + 1) * w] for v in ints] for p in range(4)]
    books = [x[:entries] for x in parts]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            to = [near(p, v)[1] for v in parts[p]]
            sums = {}
            for v, k in zip(parts[p], to, strict=True):
                n, s = sums.get(k, (0, [0] * w))
                sums[k] = n + 1, [a + b for a, b in zip(s, v, strict=True)]
            books[p] = [[a // sums[k][0] for a in sums[k][1]] if k in sums else e for k, e in enumerate(books[p])]
    out, label = [], {}
    for i, r in enumerate(kept):
        found = [near(p, parts[p][i]) for p in range(4)]
        error = sum(d for d, _ in found)
        label[r[2]] = label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), error, r[2]))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, label[lab], sha) for i, c, e, lab in out), key=str)


def vectors(n, dim, seed, values):
    r = random.Random(seed)
    return [(i * 3, [values(r) for _ in range(dim)], r.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(400, 8, 1, lambda r: r.gauss(0, 0.3)),
        vectors(300, 4, 2, lambda r: r.choice([0.0, 0.001, -0.001, 0.5])),  # ties and equal entries everywhere
        vectors(40, 12, 3, lambda r: r.uniform(-1, 1)),  # fewer vectors than entries
        vectors(330, 8, 4, lambda r: r.choice([1.0, 2.0**17, -(2.0**17) + 0.5])),  # numbers too large for exact doubles
    ],
)
def test_query_against_plain_lloyd(spark, tmp_path, rows):
    rows = [*rows, (901, None, 1), (902, [None] * len(rows[0][1]), 1), (903, [float("nan")] * len(rows[0][1]), 1), (904, [float("inf")] + [0.0] * (len(rows[0][1]) - 1), None), rows[5], (rows[7][0], rows[8][1], 2), (None, rows[9][1], 0)]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_bounds_skip_groups_and_change_nothing():
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(-500, 500, (600, 6)), np.repeat(r.integers(-500, 500, (1, 6)), 200, 0)])
    books = vector_codes.Codebooks.of(x[:256], 1)
    code, _, bounds = vector_codes.assign(x, books.entries[0], books.groups[0], None, None, None)
    skipped = 0
    for _ in range(4):
        sums = {(0, k): (int((code == k).sum()), x[code == k].sum(0).tolist()) for k in np.unique(code).tolist()}
        books = books.updated(sums)
        fallen = np.array([books.drift[0][books.groups[0] == g].max() for g in range(books.groups[0].max() + 1)])
        least = vector_codes.exact(x, books.entries[0][code])
        skipped += int((np.maximum(bounds - fallen, 0) ** 2 > least[:, None]).sum())
        code, least, bounds = vector_codes.assign(x, books.entries[0], books.groups[0], books.drift[0], code, bounds)
        d = ((x[:, None] - books.entries[0][None]) ** 2).sum(2)
        assert (d.argmin(1) == code).all() and (d.min(1) == least).all()
        for g in range(books.groups[0].max() + 1):  # no entry of a group but the own one is nearer than its bound
            mine = np.flatnonzero(books.groups[0] == g)
            others = np.where(mine[None] == code[:, None], np.iinfo(np.int64).max, d[:, mine]).min(1)
            assert (bounds[:, g] ** 2 <= others).all()
    assert skipped > 0.3 * 4 * bounds.size


def test_odd_lengths_clashing_names_and_empty_tables(spark):
    rows = [(1, [0.5, 1.0, 0.0, 0.25], "x", 1), (2, [0.5] * 3, "y", 2), (3, [], None, 3), (4, [3e38, 0.0, 0.0, 0.0], "z", 4), (5, [0.5] * 8, "z", 4), (6, None, "z", 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, `a.b` string, coded int")
    out, books = vector_codes.compress(df)
    assert out.columns == ["vec_id", "embedding", "a.b", "coded", "coded_"]
    got = {r["vec_id"]: (r["a.b"], r["coded_"]["code"], r["coded_"]["error"]) for r in out.collect()}
    assert got == {1: ("x", [0, 0, 0, 0], 0), 2: ("y", None, None), 3: (None, None, None), 4: ("z", None, None), 5: ("z", None, None)}
    assert [e.tolist() for e in books.entries] == [[[512]], [[1024]], [[0]], [[256]]]
    out, books = vector_codes.compress(df.limit(0))
    assert out.count() == 0 and books is None
