"""Numbers of the hierarchy against a walk in plain Python."""

import random

import pytest

from foliant.operators import evidence as E
from foliant.operators import order as R


def forest(seed, n=70, deep=0):
    r = random.Random(seed)
    rows = [(i, f"n{i}", f"n{r.randrange(i)}" if i and r.random() < 0.9 else "") for i in range(n)]
    rows += [(n + i, f"c{i}", f"c{i - 1}" if i else "n2") for i in range(deep)]
    rows += [(900 + i, f"k{i}", f"k{(i + 1) % 3}") for i in range(3)] + [(910, "t", "k1")]
    r.shuffle(rows)
    return rows


def brute(rows):
    kids, out = {}, {}
    for seq, i, p in sorted(rows):
        kids.setdefault(p, []).append(i)

    def walk(i):
        out[i] = [len(out) + 1, 0]
        for k in kids.get(i, []):
            walk(k)
        out[i][1] = len(out)

    for i in kids.get("", []):
        walk(i)
    return {i: tuple(x) for i, x in out.items()}


@pytest.mark.parametrize("paths", [64, -1])
def test_labels(spark, monkeypatch, paths):
    monkeypatch.setattr(R, "PATHS", paths)
    rows = forest(3, deep=20)
    r = spark.createDataFrame(rows, "seq long, id string, parent_id string")
    labels = R.order_labels(r).cache()
    got = {x.id: (x.pre, x.last) for x in labels.collect()}
    assert got == brute(rows)
    assert {x.id for x in R.under(labels, "n2").collect()} == {i for i, (a, _) in got.items() if got["n2"][0] < a <= got["n2"][1]} and R.under(labels, "gone").count() == 0
    some = spark.createDataFrame([("c9",), ("n5",), ("c9",)], "id string")
    want = {i for i, (a, b) in got.items() if any(a <= got[s][0] <= b for s in ("c9", "n5"))}
    assert sorted(x.id for x in R.with_ancestors(labels, some).collect()) == sorted(want)


def test_empty(spark):
    assert R.order_labels(spark.createDataFrame([], "seq long, id string, parent_id string")).count() == 0


def test_extremes(spark):
    r = random.Random(4)
    rows = [("a" if i < 23 else "b", i, r.randrange(100)) for i in range(37)]
    asks = [(k, f, u) for k, (f, u) in enumerate((f, u) for f in range(37) for u in range(f, 37) if (f < 23) == (u < 23))] + [(9999, 5, 4)]
    got = R.extremes(spark.createDataFrame(rows, "doc string, n long, v long"), "doc", "n", "v", spark.createDataFrame(asks, "ask long, first long, upto long")).collect()
    v = [x[2] for x in rows]
    assert sorted((x.ask, x.least, x.most) for x in got) == [(k, min(v[f : u + 1]), max(v[f : u + 1])) for k, f, u in asks[:-1]]


def test_crossings(spark):
    r = random.Random(8)
    rows = []
    for d in range(4):
        ids = []
        for i in range(40):
            head = r.random() < 0.4
            parent = r.choice([*ids[-6:], ""]) if ids else ""
            rows.append((d * 100 + i, f"D{d}-{i}", f"D{d}", parent, "section_header" if head else "text"))
            if head:
                ids.append(f"D{d}-{i}")
    up = {x[1]: x[3] for x in rows}

    def under(i, head):
        while i:
            i = up[i]
            if i == head:
                return True
        return False

    want = set()
    for s, c, doc, p, _ in rows:
        if p:
            at = next(x[0] for x in rows if x[1] == p)
            if any(x[2] == doc and x[4] == "section_header" and at < x[0] < s and not under(x[1], p) for x in rows):
                want.add((p, c))
    got = E.crossings(spark.createDataFrame(rows, "seq long, id string, doc string, parent_id string, label string"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
