"""Every query against its SQL, on the smallest tables; and the rules of search and get that these don't show."""

import os

import pytest

from foliant import queries as catalogue
from foliant.operators import checks as C
from foliant.operators import search as S

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def shown(x):
    return "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(shown, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(shown, r)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_all_levels_have_chains(spark, con):
    got = catalogue.QUERIES["ancestor_chain_all"](spark, DATA).selectExpr("substr(id, 6, 1) AS level", "size(split(chain, ' > ')) AS n").distinct().collect()
    assert {r.level: r.n for r in got} == {"N": 1, "C": 2, "O": 3, "L": 4} and len(got) == 4


def records(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, id string, doc string, page int, cite string, parent_id string, label string, text string, norm string")


ROWS = [
    ("D:p1:1", "D", 1, "1", "", "section_header", "Puertas", "puertas"),
    ("D:p1:1.1", "D", 1, "1.1", "D:p1:1", "section_header", "Ancho libre", "ancho libre"),
    ("D:p1:§1", "D", 1, "", "D:p1:1.1", "text", "Paso (a*b) de 1 m", "paso (a*b) de 1 m"),
    ("D:p1:§2", "D", 1, "", "D:p1:1.1", "picture", "", ""),
    ("D:p2:§1", "D", 2, "", "D:p1:1.1", "text", "paso y puerta", "paso y puerta"),
    ("E:p1:§1", "E", 1, "1", "gone", "text", "paso puerta", "paso puerta"),
]


def test_search(spark):
    r = records(spark, ROWS)
    got = S.search(r, ["PASO", "puert"]).collect()
    assert [(x.section_id, x.score, list(x.ancestors), list(x.matched_children)) for x in got] == [("D:p1:1.1", 2, ["Puertas"], ["D:p1:§1", "D:p2:§1"])]  # the unknown section is dropped
    assert S.search(r, ["paso"]).count() == 0 and S.search(r, ["paso", "paso"]).count() == 1 and S.search(r, []).count() == 0
    assert [x.section_id for x in S.search(r, ["(a*b)", "paso"]).collect()] == []  # no word character stands before the parenthesis
    assert [(x.section_id, x.score) for x in S.search(r, ["ancho", "libre"]).collect()] == [("D:p1:1", 2)]  # a heading counts for its parent
    assert [x.score for x in S.search(r, ["", "paso"]).collect()] == [2]  # the empty term is met by any word


def test_get(spark):
    found, unknown = S.get(records(spark, ROWS), ["D:p2:§1", "D:p1:1,1.1", "a,b", "D:p2:§1"])
    assert [(x.id, list(x.ancestors), [c.id for c in x.children]) for x in found.collect()] == [
        ("D:p2:§1", ["Puertas", "Ancho libre"], []), ("D:p1:1", [], ["D:p1:1.1"]), ("D:p1:1.1", ["Puertas"], ["D:p1:§1", "D:p1:§2", "D:p2:§1"]), ("D:p2:§1", ["Puertas", "Ancho libre"], [])]
    assert [x.id for x in unknown.collect()] == ["a,b"]


def test_pages_and_cites(spark):
    r = records(spark, ROWS)
    prov = spark.createDataFrame([("D", 1, 3, "native")], "doc string, page_from int, page_to int, source string")
    assert [x.id for x in S.get_page(r, prov, "D", 1).collect()] == [x[0] for x in ROWS[:4]] and S.get_page(r, prov, "D", 3).count() == 0
    for doc, page in (("D", 0), ("D", 4), ("X", 1)):
        with pytest.raises(S.UnknownPageError):
            S.get_page(r, prov, doc, page)
    assert [x.id for x in S.get_by_cite(r, "1").collect()] == ["D:p1:1", "E:p1:§1"] and S.get_by_cite(r, "").count() == 0 and S.get_by_cite(r, "1", "E").count() == 1


def test_broken_chains(spark):
    rows = spark.createDataFrame([(0, "a", "b", "A"), (1, "b", "a", "B"), (2, "s", "s", "S"), (3, "x", "gone", "X")], "seq long, id string, parent_id string, text string")
    got = {x.id: list(x.ancestors) for x in S.chain_texts(rows.select("id"), S.ancestry(rows), rows).collect()}
    assert got == {"a": ["A", "B"], "b": ["B", "A"], "s": ["S"]}


def test_long_chains(spark):
    rows = [(i, f"c{i}", f"c{(i + 1) % 70}", "") for i in range(70)] + [(100 + i, f"d{i}", f"d{i - 1}" if i else "", "") for i in range(80)]
    r = spark.createDataFrame(rows, "seq long, id string, parent_id string, text string")
    assert {x.id for x in C.cycles(r).collect()} == {f"c{i}" for i in range(70)}
    assert S.ancestry(r, ids=r.filter("id = 'd79'").select("id")).count() == 79


def test_wire_pool(spark):
    pool = S.wire_pool(S.search(records(spark, ROWS), ["paso", "puert"])).collect()
    assert [(x.text, x.place) for x in pool] == [("Puertas", 0)]
