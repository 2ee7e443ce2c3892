"""Rules of the content gates, optical words, evidence and interchange files that the queries don't show, and the commands."""

import json
import math
import random
import re

import pytest

from foliant import registry
from foliant.operators import analytics as A
from foliant.operators import evidence as E
from foliant.operators import gates as T
from foliant.operators import ocr as O
from foliant.operators import search as S
from foliant.plans import carriers as P
from foliant.sources import tables, tsv


def records(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, id string, doc string, page int, cite string, parent_id string, label string, text string, norm string")


def test_splice_moves_operators_only():
    assert O.splice("ancho > 80 cm y fondo 3 m", "ancho ≥ 80 cm y fonda 3 m") == "ancho ≥ 80 cm y fondo 3 m"
    assert O.splice("a b", "a ≥ b") == "a b" and O.splice("", "≤") == "" and O.splice("x y z", "≤ q r z") == "x y z"
    r = random.Random(3)
    for _ in range(100):
        base = [r.choice("abcdefgh") for _ in range(r.randint(0, 12))]
        k = {i for i in range(len(base)) if r.random() < 0.2}
        other = ["≥" if i in k else w for i, w in enumerate(base)]
        got = O.splice(" ".join(base), " ".join(other)).split()
        assert len(got) == len(base) and all(g in (b, o) for g, b, o in zip(got, base, other, strict=True))


def test_spliced_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "a > 2", "a ≥ 2"), (2, None, "≥"), (3, "b", None)], "k int, base string, other string")
    assert [(x.k, x.spliced) for x in O.spliced(rows).orderBy("k").collect()] == [(1, "a ≥ 2"), (2, ""), (3, "b")]


def test_words_are_read_unquoted(spark, tmp_path):
    f = tmp_path / "words.tsv"
    f.write_text('level\tpage\tblock_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t10\t20\t30\t8\t96.5\t"quoted\n5\t1\t1\t1\t1\tx\t20\t30\t8\t-1\tlost\n', encoding="utf-8")
    got = O.read_words(spark, str(f)).collect()
    assert [(r.left, r.conf, r.text) for r in got] == [(10, 96.5, '"quoted'), (None, -1.0, "lost")]
    assert [r.text for r in O.lines(O.read_words(spark, str(f))).collect()] == ['"quoted']


def test_markers(spark):
    rows = [("3.",), ("¢)",), ("I.",), ("iv)",), ("xx",), ("12",), ("a",), ("1Z.",), (None,)]
    got = spark.createDataFrame(rows, "t string")
    assert [r.m for r in got.select(O.marker_of(got.t).alias("m")).collect()] == ["3.", "c)", "l.", "iv)", None, "12", None, None, None]


def test_gates(spark):
    r = records(spark, [("D:p1:1", "D", 1, "A.2", "", "section_header", "Alturas", "alturas"), ("D:p1:2", "D", 1, "A.2.2", "D:p1:1", "section_header", "Huecos", "huecos"), ("D:p1:3", "D", 1, "", "D:p1:2", "text", "ángulo de 60º", "x"), ("D:p1:4", "D", 1, "", "D:p1:1", "text", "otros ≥ 60 °", "x")])
    assert {(x.id, tuple(x.chain), x.ok) for x in T.chains(r, "60", ["A.2.2", "A.2"]).collect()} == {("D:p1:3", ("A.2.2", "A.2"), True), ("D:p1:4", ("A.2",), False)}
    assert {x.angle: x.n for x in T.angles(r).collect()} == {"60º": 1, "60°": 1}
    gates = T.phantoms(r, {"60": r"\b60\b", "none": "zzz"}), T.furniture(r, ["otros"])
    assert sorted(x.what for x in T.failures(*gates).collect()) == ["60", "otros"]
    empty = r.filter("false")
    assert [(x.n, x.ok) for x in T.symbol_bands(empty, spark.createDataFrame([("≥", 0)], "what string, least int")).collect()] == [(0, True)]


def test_section_crossings(spark):
    def heads(rows):
        return records(spark, [(i, "D", 1, "", p, "section_header" if i[0] == "h" else "text", i, i) for i, p in rows])

    sound = [("h1", ""), ("a", "h1"), ("h2", "h1"), ("b", "h2"), ("h3", "h1"), ("c", "h3"), ("h4", ""), ("d", "h4")]
    assert E.crossings(heads(sound)).count() == 0
    late = [*sound, ("e", "h1"), ("f", "h4")]  # e stands past h4, which isn't below h1
    assert [(x["head"], x.child) for x in E.crossings(heads(late)).collect()] == [("h1", "e")]
    odd = [("h1", ""), ("h2", ""), ("h3", "h1"), ("a", "h3"), ("b", "h1")]
    assert sorted((x["head"], x.child) for x in E.crossings(heads(odd)).collect()) == [("h1", "b"), ("h1", "h3")]


def test_citation_line(spark):
    r = records(spark, [("D:p3:1", "D", 3, "A.2", "", "section_header", "Alturas", "x"), ("D:p3:2", "D", 3, "", "D:p3:1", "text", "Pág. 4411", "x"), ("D:p3:3", "D", 3, "", "D:p3:1", "text", "otra", "x"), ("D:p4:1", "D", 4, "", "D:p3:1", "text", "cuarta", "x")])
    got = {x.id: (x.printed, x.line) for x in E.citations(r).collect()}
    assert got["D:p3:3"] == (4411, "D, p. 3, printed 4411, A.2, D:p3:3") and got["D:p4:1"] == (None, "D, p. 4, A.2, D:p4:1") and got["D:p3:1"][1] == "D, p. 3, printed 4411, D:p3:1"


def test_pointers_name_what_follows_them(spark):
    r = records(spark, [("1", "D", 1, "", "", "text", "el artículo 129 de la Ley 39/2015 y el artículo 12", ""), ("2", "D", 1, "", "", "text", "según la figura 3.1 o Tabla IV", ""), ("3", "D", 1, "", "", "text", "nada", "")])
    got = sorted((x.id, x.k, x.noun, x.address, x.kind) for x in E.pointers(r).collect())
    assert got == [("1", 0, "artículo", "129", "external"), ("1", 1, "artículo", "12", "in_corpus"), ("2", 0, "figura", "3.1", "figure"), ("2", 1, "Tabla", "IV", "in_corpus")]


def test_index_lines_and_routes(spark, tmp_path):
    terms = spark.createDataFrame([("s1", "ancho", 2), ("s1", "puerta", 1), ("s2", "rampa", 1)], "section_id string, term string, rank int")
    heads = spark.createDataFrame([("s1", "D:p1", "Huecos"), ("s2", "D:p2", "Rampas")], "section_id string, ref string, title string")
    lines = E.index_lines(terms, heads)
    assert {x.ref: x.line for x in lines.collect()} == {"D:p1": "D:p1 | Huecos | puerta ancho", "D:p2": "D:p2 | Rampas | rampa"}
    E.write_index(lines, f"{tmp_path}/index")
    assert spark.read.text(f"{tmp_path}/index").count() == 2
    sections = spark.createDataFrame([("D:p1", "la puerta de ancho libre"), ("D:p3", "una Puerta más")], "ref string, text string")
    assert {(x.ref, x.hits, x.routed) for x in E.routed_hits(lines, sections, "puerta").collect()} == {("D:p1", 1, True), ("D:p3", 1, False)}


def test_index_terms_leave_stop_words_out(spark):
    r = records(spark, [("D:p1:1", "D", 1, "", "", "text", "Puertas entre puertas sobre pasillo", ""), ("D:p1:2", "D", 1, "", "", "text", "rampa Rampa entre ventana", ""), ("D:p1:3", "D", 1, "", "", "text", "ventana sobre escalera", "")])
    got = {(x.section_id, x.term): x["rank"] for x in A.index_terms(r, 2).collect()}
    assert got == {("D:p1:1", "puertas"): 1, ("D:p1:1", "pasillo"): 2, ("D:p1:2", "rampa"): 1, ("D:p1:2", "ventana"): 2, ("D:p1:3", "escalera"): 1, ("D:p1:3", "ventana"): 2}


def test_wire_and_back(spark):
    rows = [("D:p1:1", "", "Raíz"), ("D:p1:1.1", "D:p1:1", "Norte"), ("D:p1:§1", "D:p1:1.1", "paso ancho"), ("D:p2:§1", "D:p1:1.1", "paso puerta ancho"), ("D:p1:1.2", "D:p1:1", "Sur"), ("D:p3:§1", "D:p1:1.2", "ancho paso"), ("E:p1:1", "", "paso ancho")]
    r = records(spark, [(i, i[0], 1, "", p, "text", t, t.lower()) for i, p, t in rows])
    found = S.search(r, ["paso", "ancho"])
    pool, sections = S.wire(found)
    assert {x.text: x.place for x in pool.collect()} == {"Raíz": 0}
    show = lambda x: (x.section_id, x.score, list(x.ancestors), list(x.matched_children))
    assert sorted(map(show, S.unwire(pool, sections).collect())) == sorted(map(show, found.collect()))
    none = S.unwire(*S.wire(S.search(r, ["zz", "yy"])))
    assert none.count() == 0


def test_cites_have_ancestors(spark):
    r = records(spark, [("D:p1:1", "D", 1, "1", "", "section_header", "Raíz", ""), ("D:p1:1.1", "D", 1, "1.1", "D:p1:1", "text", "x", "")])
    assert [(x.id, list(x.ancestors)) for x in S.get_by_cite(r, "1.1").collect()] == [("D:p1:1.1", ["Raíz"])]


def test_chains_of_any_depth(spark):
    rows = [(f"D:p1:{i}", "D", 1, "", f"D:p1:{i - 1}" if i else "", "text", str(i), "") for i in range(75)]
    r = records(spark, rows)
    last = r.filter("seq = 74").select("id")
    assert S.ancestry(r, ids=last).count() == 74


def test_gold_set(spark, tmp_path):
    q, a = tmp_path / "q.csv", tmp_path / "a.csv"
    q.write_text('set,number,question\neasy,1,"What ""is"" it,\nthen?"\neasy,2,x\n,,\n', encoding="utf-8")
    a.write_text("set,number,answer,sources\neasy,1,this,D:p1\neasy,2,that,\n", encoding="utf-8")
    got = {x.number: (x.question, x.answer, x.sources) for x in tables.gold_set(spark, str(q), str(a)).collect()}
    assert got == {"1": ('What "is" it,\nthen?', "this", "D:p1"), "2": ("x", "that", "")}
    a.write_text("set,number,answer,sources\neasy,1,this,D:p1\n", encoding="utf-8")
    with pytest.raises(tables.GoldError):
        tables.gold_set(spark, str(q), str(a))


def test_a_run_over_documents_goes_on(spark):
    def convert(name):
        if name == "b":
            raise OSError("unreadable")

    names = lambda *x: spark.createDataFrame([(i,) for i in x], "doc string")
    got = tables.convert_all(names("a", "b", "c", "a"), names("c", "z"), convert).orderBy("doc").collect()
    assert [(x.doc, x.status) for x in got] == [("a", "converted"), ("b", "failed"), ("c", "skipped")] and "unreadable" in got[1].error
    assert tables.convert_all(names("c"), names("c"), convert, force=True).first().status == "converted"


def test_bad_lines_are_told_with_their_number(spark, tmp_path):
    f = tmp_path / "p.tsv"
    f.write_text("\t".join(tsv.PROVENANCE) + "\nD\t1\t2\tnative\nD\tone\t2\tocr\n", encoding="utf-8")
    with pytest.raises(Exception, match="line 3: page_from is no number"):
        tsv.read_tsv(spark, str(f), tsv.PROVENANCE).collect()
    f.write_text("\t".join(tsv.PROVENANCE) + "\nD\t1\t2\tnative\nD\t3\n", encoding="utf-8")
    with pytest.raises(Exception, match="line 3: another number of fields"):
        tsv.read_tsv(spark, str(f), tsv.PROVENANCE).collect()


def test_buckets_of_documents(spark, tmp_path):
    r = records(spark, [(f"D{i}:p1:1", f"D{i}", 1, "", "", "text", "t", "t") for i in range(40)])
    tsv.write_parquet(r, f"{tmp_path}/r", 4)
    assert tsv.read_parquet(spark, f"{tmp_path}/r").count() == 40
    one = tsv.read_parquet(spark, f"{tmp_path}/r", "D7", 4)
    assert one.count() == 1 and "bucket" in one._jdf.queryExecution().toString() and len(one.columns) == len(r.columns)


def test_root(tmp_path, monkeypatch):
    monkeypatch.delenv(registry.ROOT_VARIABLE, raising=False)
    (tmp_path / "a/b").mkdir(parents=True)
    with pytest.raises(registry.RootError):
        registry.root(start=str(tmp_path / "a/b"))
    (tmp_path / registry.ANCHOR).touch()
    assert registry.root(start=str(tmp_path / "a/b")) == tmp_path.resolve()
    monkeypatch.setenv(registry.ROOT_VARIABLE, str(tmp_path / "a"))
    assert registry.root(start=str(tmp_path / "a/b")) == (tmp_path / "a").resolve() and registry.root(str(tmp_path)) == tmp_path.resolve()


def layout_of(texts):
    item = lambda i, label, text: {"label": label, "text": text, "prov": [{"page_no": 1, "bbox": {"l": 10, "r": 90, "t": 800 - 20 * i, "b": 790 - 20 * i, "coord_origin": "BOTTOMLEFT"}}]}
    return {"texts": [item(i, *t) for i, t in enumerate(texts)], "tables": [], "pictures": [], "pages": {"1": {"size": {"width": 100, "height": 842}}}}


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "layouts").mkdir()
    for name in ("Alpha", "Beta", "stray"):
        (tmp_path / f"layouts/{name}.json").write_text(json.dumps(layout_of([("section_header", "A.2 Alturas"), ("text", f"{name} mide ≥ 60º"), ("page_footer", "pie")])))
        (tmp_path / f"layouts/{name}.pipeline.json").write_text(json.dumps({"profile": "native"}))
    where = ["--root", str(tmp_path)]
    assert registry.main([*where, "ingest", "--docs", "Alpha", "Beta", "--stats"], spark) == 0
    assert "furniture\t2" in capsys.readouterr().out
    corpus = registry.Corpus.load(spark, f"{tmp_path}/corpus")
    assert [x.id for x in corpus.records.orderBy("seq").collect()] == ["ALP:p1:A.2", "ALP:p1:§1", "BET:p1:A.2", "BET:p1:§1"]  # the stray file isn't scanned
    assert [x.id for x in corpus.get_by_cite("A.2").collect()] == ["ALP:p1:A.2", "BET:p1:A.2"] and corpus.get_page("ALP", 1).count() == 2
    assert [x.section_id for x in corpus.search(["alpha", "mide"]).collect()] == ["ALP:p1:A.2"] and corpus.get(["ALP:p1:§1"])[0].count() == 1
    assert registry.main([*where, "check"], spark) == 0
    expect = tmp_path / "expect.csv"
    expect.write_text("kind,what,least\nsymbol,≥,1\nangle,60º,1\n", encoding="utf-8")
    assert registry.main([*where, "check-content", "--doc", "ALP", "--expect", str(expect)], spark) == 0
    expect.write_text("kind,what,least\nsymbol,²,1\nangle,90º,1\n", encoding="utf-8")
    assert registry.main([*where, "check-content", "--doc", "ALP", "--expect", str(expect)], spark) == 1
    child, head = (corpus.records.filter(f"id = 'ALP:p1:{x}'").first() for x in ("§1", "A.2"))
    word = child.text.split()[0]
    for line, fails in ((f"chain,{word} | {head.cite},", 0), (f"chain,{word} | B.9,", 1), ("chain,nowhere | A.2,", 1), (f"phantom,{word},", 1), ("phantom,zzz+,", 0), (f"furniture,{word},", 1), ("furniture,ISSN,", 0)):
        expect.write_text(f"kind,what,least\n{line}\n", encoding="utf-8")
        assert registry.main([*where, "check-content", "--doc", "ALP", "--expect", str(expect)], spark) == fails, line
    with pytest.raises(ValueError, match="code"):
        registry.registered(spark, ["Alpha", "alpine"])


def test_evaluate(spark, tmp_path, capsys):
    files = {"questions": "set,number,question\na,1,q\na,2,q\nb,1,q\n", "answers": "set,number,answer,sources\na,1,x,s\na,2,x,s\nb,1,x,s\n", "results": "set,number,passed\na,1,true\na,2,false\nb,1,True\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    call = ["evaluate", *(x for name in files for x in (f"--{name}", str(tmp_path / f"{name}.csv")))]
    assert registry.main(call, spark) == 0 and capsys.readouterr().out == "a\t1\t2\t0.500\nb\t1\t1\t1.000\n"
    assert registry.main([*call, "--least", "0.6"], spark) == 1


def test_layers_and_shares(spark):
    pages = spark.createDataFrame([("a", p, 500 if p % 2 else 20) for p in range(1, 101)] + [("b", 1, 900)], "doc string, page int, chars long")
    got = {x.doc: x for x in E.text_layer(pages).collect()}
    assert (got["a"].pages, got["a"].sampled, got["b"].sampled, got["b"].sparse_fraction) == (100, 40, 1, 0.0)
    want = [500 if (int(i * 99 / 39) + 1) % 2 else 20 for i in range(40)]
    assert got["a"].sparse_fraction == round(sum(c < 100 for c in want) / 40, 3) and [x.doc for x in E.needs_ocr(E.text_layer(pages), 0.4).collect()] == ["a"]
    s = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    assert [x.s for x in s.select(E.share_text(s.a, s.b).alias("s")).collect()] == ["33.3%", "0.0%"]


def test_phrases_of_one_two_and_more_words(spark):
    texts = spark.createDataFrame([(0, "a b c d"), (1, "b c x c d"), (2, "d a b, c"), (3, None), (4, "b")], "id long, norm string")
    for asked in (["b", "a b", "b - c"], ["b c d", "a b", "x", "a b c d", "c x c", "zz", "b zz"], ["a b"], ["zz zz"], []):
        got = E.phrase_hits(texts, spark.createDataFrame([(p,) for p in asked], "phrase string")).collect()
        bare = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t or "").split()) + " "
        want = sorted((i, p) for i, t in texts.collect() for p in asked if bare(p) in bare(t))
        assert sorted(map(tuple, got)) == want


def test_deference_of_documents_with_many_names(spark):
    r = spark.createDataFrame([("1", "A", "b c and e f"), ("2", "B", "b c"), ("3", "C", "none")], "id string, doc string, norm string")
    many = [(f"D{i}", n) for i in range(600) for n in ("b c", "e f")]
    names = spark.createDataFrame([*many, ("A", "b c"), ("A", "b c"), ("B", "g h"), ("E", None)], "doc string, name string")
    got = sorted(map(tuple, E.deference(r, names).collect()))
    assert got == sorted([(i, d, f"D{n}") for i, d in (("1", "A"), ("2", "B")) for n in range(600)] + [("2", "B", "A")])


def test_only_found_names_are_shuffled(spark):
    """The rows of the answer are made by the last join: no exchange stands above it."""
    r = spark.createDataFrame([("1", "A", "b c"), ("2", "B", "b c")], "id string, doc string, norm string")
    plan = E.deference(r, spark.createDataFrame([("A", "b c"), ("B", "b c")], "doc string, name string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def brute_deference(r, names):
    bare = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t or "").split()) + " "
    return sorted({(i, d, t) for i, d, n in r for t, name in names if name and t != d and bare(name) in bare(n)})


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("known", [1_000_000, 100])
def test_deference_by_both_ways(spark, monkeypatch, known, several):
    """Groups of several parts, names met often and never, repeated ids and documents: by names that go to the texts, and by shares of those met."""
    monkeypatch.setattr(E, "KNOWN", known)
    monkeypatch.setattr(E, "HITS", 7)
    rows = [(str(i % 90), f"D{i % 45}", " ".join(("a b", "c d", "e f", "x", "")[(i * 7 + j) % 5] for j in range(i % 4))) for i in range(100)] + [("n", "N", None)]
    named = [(f"D{i}", ("a b", "c d", "e f", "g h")[i * i % 4 if i < 600 else i % 4]) for i in range(900)] + [("D1", None), ("D2", "c d")]
    named += [("D3", "e f"), ("D3", "a b")] if several else []
    named = named if several else [(d, n) for d, n in named if (d, n) != ("D2", "c d")]
    got = E.deference(spark.createDataFrame(rows, "id string, doc string, norm string"), spark.createDataFrame(named, "doc string, name string"))
    assert sorted(map(tuple, got.collect())) == brute_deference(rows, named)


def test_met_names_are_not_shuffled(spark):
    """Documents go to the records that name them: of records that don't share ids nothing is shuffled, and nothing is repeated for each part of a group."""
    rows, named = [(f"r{i}", f"D{i}", "b c d" if i % 2 else "c b") for i in range(20)], [(f"D{i}", "b c") for i in range(600)]
    out = E.deference(spark.createDataFrame(rows, "id string, doc string, norm string"), spark.createDataFrame(named, "doc string, name string"), once=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "sequence(" not in plan
    assert sorted(map(tuple, out.collect())) == brute_deference(rows, named)


def test_deference_stores_no_records(spark, tmp_path):
    """Of documents, one of them twice, only names are stored; both have the rows of the SQL, and a document that comes twice is told by whole rows."""
    from foliant import queries as catalogue

    duckdb = pytest.importorskip("duckdb")
    for k, more in enumerate(["", " UNION ALL SELECT 3, 'palabra una' || chr(10) || 'otra cosa'"]):
        d = tmp_path / str(k)
        d.mkdir()
        duckdb.execute(f"COPY (SELECT i AS doc_id, CASE i % 3 WHEN 0 THEN 'palabra una y otra cosa' WHEN 1 THEN 'otra cosa' || chr(10) || 'palabra una' ELSE 'sola' END AS text FROM range(30) t(i){more}) TO '{d}/documents.parquet'")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
        before = set(P._KEPT)
        got = catalogue.QUERIES["deference"](spark, str(d)).select("id", "doc", "target").collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT id, doc, target FROM ({catalogue.ORACLES['deference']})").fetchall())
        assert set(P._KEPT) == before


def test_weights_shuffle_records_once(spark):
    """The one exchange that is asked for is by document; what stands above it needs none of terms."""
    r = spark.createDataFrame([(0, "a", "D", "", "puerta puerta ancho"), (1, "b", "D", "", "puerta libre"), (2, "c", "E", "", "puerta")], "seq long, id string, doc string, parent_id string, norm string")
    got = {(x.doc, x.section_id, x.term): (x.tf, x.df, round(x.weight, 6)) for x in A.tfidf(r).collect()}
    assert got == {("D", "a", "puerta"): (2, 2, -0.81093), ("D", "a", "ancho"): (1, 1, 0.0), ("D", "b", "puerta"): (1, 2, -0.405465), ("D", "b", "libre"): (1, 1, 0.0), ("E", "c", "puerta"): (1, 1, -0.693147)}
    plan = A.tfidf(r)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc#" in plan and not any("hashpartitioning" in line and "term#" in line for line in plan.splitlines())


def test_weights_read_records_once_and_without_their_norms(spark):
    """One branch, so records are shuffled once, and of a norm its words only."""
    r = spark.createDataFrame([(k, f"s{k % 7}", "DE"[k % 2], "" if k < 7 else f"s{k % 5}", " ".join(f"palabra{chr(97 + j % (k % 9 + 1))} de" for j in range(k % 11))) for k in range(60)], "seq long, id string, doc string, parent_id string, norm string")
    plan = A.tfidf(r, stop=["palabrab"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want, rows = {}, [(x.doc, x.parent_id or x.id, t) for x in r.collect() for t in re.findall("[a-z]{5,}", x.norm) if t != "palabrab"]
    for doc, section, t in rows:
        df, n = len({s for d, s, u in rows if (d, u) == (doc, t)}), len({s for d, s, _ in rows if d == doc})
        tf = rows.count((doc, section, t))
        want[doc, section, t] = (tf, df, round(tf * math.log(n / (1 + df)), 6))
    assert {(x.doc, x.section_id, x.term): (x.tf, x.df, round(x.weight, 6)) for x in A.tfidf(r, stop=["palabrab"]).collect()} == want
