"""Boxes in boxes, pages in ranges and ranks, against plain Python."""

import random

import pytest

from foliant.operators import analytics as A
from foliant.operators import checks as C
from foliant.operators import geometry as G

BOX = "l double, r double, t double, b double"


@pytest.mark.parametrize("spread", [40.0, 900.0])
def test_contained(spark, spread):
    r = random.Random(3)

    def box(size):
        left, top = r.uniform(-spread, spread), r.uniform(-spread, spread)
        w, h = r.choice([0, r.uniform(0, size)]), r.uniform(-size, size)
        return (left, left + w, top, top + h)

    inner = [(k % 3, k, *box(20)) for k in range(300)] + [(0, 900, 30.0, 10.0, 0.0, 5.0), (1, 901, None, 3.0, 0.0, 1.0), (1, 902, 2.0, 2.0, 2.0, 2.0)]
    outer = [(k % 3, k, *box(r.choice([15, 80, 700, 1e7]))) for k in range(120)] + [(0, 900, 12.0, 28.0, -5.0, 9.0), (1, 901, 4.0, 0.0, 0.0, 4.0), (1, 902, 0.0, None, 0.0, 4.0), (1, 903, 4.0, 4.0, 4.0, 4.0)]
    a, b = spark.createDataFrame(inner, f"page int, i int, {BOX}"), spark.createDataFrame(outer, f"page int, o int, {BOX}")

    def inside(x, y, pad=2.0):
        if None in x or None in y:
            return False
        (l, w, t, u), (m, z, v, q) = x, y
        return l >= m - pad and w <= z + pad and min(t, u) >= min(v, q) - pad and max(t, u) <= max(v, q) + pad

    want = sorted((i, o) for p, i, *x in inner for q, o, *y in outer if p == q and inside(x, y))
    assert sorted(map(tuple, G.contained(a, b, ["page"]).collect())) == want and len(want) > 100
    assert G.contained(a.limit(0), b, ["page"]).count() == 0 and G.contained(a, b.limit(0), ["page"]).count() == 0


def test_covering(spark):
    r = random.Random(5)
    spans = [("d", a, a + r.choice([0, 1, 5, 90, 4000, -3]), f"s{k}") for k, a in enumerate(r.randrange(-50, 600) for _ in range(200))] + [("e", 0, 10**12, "all")]
    points = [(r.choice("def"), r.randrange(-60, 700)) for _ in range(150)]
    got = G.covering(spark.createDataFrame(points, "doc string, page long"), spark.createDataFrame(spans, "doc string, a long, z long, s string"), ["doc"], "page", "a", "z").select("doc", "page", "s").collect()
    assert sorted(map(tuple, got)) == sorted((d, p, s) for d, p in points for e, a, z, s in spans if d == e and a <= p <= z)


def test_sources_of_records(spark):
    rec = spark.createDataFrame([("a", "D", 1, "text"), ("b", "D", 3, "table"), ("c", "D", 9, "text"), ("d", "E", 1, "text")], "id string, doc string, page int, label string")
    prov = spark.createDataFrame([("D", 1, 2, "native"), ("D", 3, 4, "ocr"), ("D", 3, 3, "native")], "doc string, page_from int, page_to int, source string")
    assert sorted((x.id, x.source) for x in C.with_source(rec, prov).filter("source IS NOT NULL").collect()) == [("a", "native"), ("b", "native"), ("b", "ocr")]
    assert {x.id for x in C.with_source(rec, prov).filter("source IS NULL").collect()} == {"c", "d"}


def test_ranks(spark):
    r = random.Random(6)
    values = [r.choice([None, 1, 2, 3, 50, 999, r.randrange(10**6)]) for _ in range(500)]
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = A.nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", shares)
    line = sorted(values, key=lambda v: (v is not None, v or 0))
    assert {x.share: x.value for x in got.collect()} == {s: line[round((len(line) - 1) * s)] or 0 for s in shares}
