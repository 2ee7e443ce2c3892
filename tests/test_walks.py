"""Walks up the hierarchy by levels and by jumps, and search by postings, against plain Python."""

import random
import re

import pytest

from foliant import queries as catalogue
from foliant.functions.text import normalize
from foliant.operators import search as S
from foliant.plans import carriers


def brute(rows, ids=None):
    up = {i: p for i, p in rows if p}
    known = {i for i, _ in rows}
    out = set()
    for i in known if ids is None else ids & known:
        at, n, seen = up.get(i), 1, set()
        while at in known and at not in seen:
            out.add((i, at, n))
            seen.add(at)
            at, n = up.get(at), n + 1
    return out


def forest(seed):
    r = random.Random(seed)
    rows = [(f"n{i}", f"n{r.randrange(i)}" if i and r.random() < 0.95 else "") for i in range(60)]
    rows += [(f"c{i}", f"c{i - 1}" if i else "n3") for i in range(30)]  # a deep chain
    rows += [(f"k{i}", f"k{(i + 1) % 7}") for i in range(7)] + [("s", "s"), ("t1", "k2"), ("t2", "t1"), ("u", "gone"), ("v", "u")]  # cycles, ways into them, an unknown parent
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, steps, some", [(100_000, 12, False), (100_000, 3, True), (0, 12, True)])
def test_ancestry(spark, monkeypatch, small, steps, some):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "STEPS", steps)
    rows = forest(4)
    r = spark.createDataFrame(rows, "id string, parent_id string")
    ids = {"c29", "k3", "s", "t2", "v", "n40", "nope"} if some else None
    got = S.ancestry(r, ids=spark.createDataFrame([(i,) for i in ids], "id string") if some else None).collect()
    assert len(got) == len(brute(rows, ids)) and {tuple(x) for x in got} == brute(rows, ids)
    if some:
        for depth in (1, 5):
            got = S.ancestry(r, depth, spark.createDataFrame([(i,) for i in ids], "id string"))
            assert {tuple(x) for x in got.collect()} == {x for x in brute(rows, ids) if x[2] <= depth}


def test_roots(spark):
    rows = forest(5)
    chains = {}
    for i, a, n in brute(rows):
        chains.setdefault(i, {})[n] = a
    endless = {i for i in chains if any(a == i or a[0] in "ks" for a in chains[i].values())}
    want = {i: (None, None) if i in endless else (chains[i][max(chains[i])], max(chains[i])) if i in chains else (i, 0) for i, _ in rows}
    got = S.roots(spark.createDataFrame(rows, "id string, parent_id string")).collect()
    assert len(got) == len(rows) and {x.id: (x.root, x.depth) for x in got} == want
    assert S.roots(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def test_all_chains(spark, monkeypatch):
    """Each record takes its parent's chain: nothing stored has a row for each ancestor, unless a way leads into a cycle."""
    rows = forest(6)
    chains = {}
    for i, a, n in brute(rows):
        chains.setdefault(i, []).append((n, a.upper()))
    want = {i: [t for _, t in sorted(c, reverse=True)] for i, c in chains.items()}
    frame = lambda rows: spark.createDataFrame(rows, "id string, parent_id string").selectExpr("id", "parent_id", "upper(id) AS text")
    for parents in (None, frame(rows)):
        got = S.all_chains(frame(rows), parents).collect()
        assert len(got) == len(want) and {x.id: list(x.ancestors) for x in got} == want
    names, keep = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: names.append(name) or keep(df, name))
    tree = [x for x in rows if x[0][0] in "ncuv"]
    got = S.all_chains(frame(tree)).collect()
    assert {x.id: list(x.ancestors) for x in got} == {i: want[i] for i, _ in tree if i in want} and set(names) == {"parents", "chains"}
    assert S.all_chains(frame([])).count() == 0


def test_all_chains_of_the_query_store_no_closure(spark, monkeypatch):
    names, keep = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: names.append(name) or keep(df, name))
    assert catalogue.QUERIES["ancestor_chain_all"](spark, "/root/testdata/sf0.001").count() and set(names) == {"parents", "chains"}


TEXTS = ["Paso (a*b) de 1 m", "paso y puerta", "el paso-puerta", "ß straße", "x_y z1", "m² de paso", "", "ñandú 中文 paso", "1.2 paso.", "pasos de puertas"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(2)
    rows = []
    for i in range(300):
        section = i - i % 5
        rows.append((i, f"D:p{i // 20 + 1}:{i}", "D", i // 20 + 1, "" if i == section else "gone" if i % 50 == 49 else f"D:p{section // 20 + 1}:{section}", " ".join(r.sample(TEXTS, 2))))
    df = spark.createDataFrame(rows, "seq long, id string, doc string, page int, parent_id string, text string").withColumn("norm", normalize("text"))
    path = str(tmp_path_factory.mktemp("index"))
    df.write.parquet(f"{path}/records")
    records = spark.read.parquet(f"{path}/records")
    S.write_postings(records, f"{path}/terms")
    return records, spark.read.parquet(f"{path}/terms")


@pytest.mark.parametrize("terms", [["paso", "puert"], ["paso", "paso"], ["straße", "m2"], ["(a*b)", "paso"], ["", "paso"], ["1.2", "1"], ["paso-p", "de 1"], ["x_", "中"], ["puerta paso", "el"], ["zz", "paso"], []])
def test_postings_give_what_a_scan_gives(corpus, terms):
    records, index = corpus
    heads = records.selectExpr("id AS section_id", "seq", "doc", "page")
    shown = lambda df: sorted((x.section_id, x.score, tuple(x.children), x.seq, x.doc, x.page) for x in df.collect())
    assert shown(S.search_indexed(index, records, terms)) == shown(S.section_scores(records, terms).join(heads, "section_id"))


def test_terms_read_the_files_of_their_letters(corpus):
    records, index = corpus
    plan = S.search_indexed(index, records, ["paso", "puert"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*initial#\d+ = 112", plan) and "StringStartsWith(word,paso)" in plan and "norm" not in plan
    assert len({f.rpartition("/")[0] for f in index.inputFiles()}) > 5


def test_postings_are_written_without_a_shuffle(corpus):
    records, index = corpus
    assert "Exchange" not in S.postings(records)._jdf.queryExecution().executedPlan().toString() and index.columns == ["word", "seq", "initial"]
    hits = S.search_indexed(index, records, ["th.", "er."])._jdf.queryExecution().optimizedPlan().toString()
    assert not any("norm" in line and "Join" in line for line in hits.splitlines())


@pytest.mark.parametrize("name", ["search_metachar", "search_dup_terms", "search_single_term_empty"])
def test_a_search_stores_words_but_no_records(spark, tmp_path, name):
    texts = ["the three th. er.\nther er. th.\nthread", "nothing", "", "there\nthe thrée"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(x)[1:5] for x in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
    assert found == {"search_metachar": [(2, "D0", 1, "D0:p1:§1")], "search_dup_terms": [(2, "D0", 1, "D0:p1:§1"), (2, "D3", 1, "D3:p1:§1")], "search_single_term_empty": []}[name]
    assert {k[2] for k in carriers._KEPT if k[1] == str(tmp_path)} == {"terms"}
