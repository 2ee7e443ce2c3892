"""Layout to records on a small document, the gates, the files and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from foliant import queries as catalogue
from foliant.operators import checks, ingest
from foliant.sources import layout, tsv
from foliant.streaming import arrivals


def box(left, top, right=None, bottom=None):
    return {"l": left, "r": right or left + 100, "t": top, "b": bottom if bottom is not None else top - 10, "coord_origin": "BOTTOMLEFT"}


def item(label, text, page, left, top, **more):
    return {"label": label, "text": text, "prov": [{"page_no": page, "bbox": box(left, top)}], **more}


DOC = {
    "pages": {"1": {}, "2": {}, "3": {}},
    "texts": [
        item("text", "Body of A.1 in 30 m²", 1, 70, 650),
        item("section_header", "Anejo A Terms", 1, 70, 700),
        item("list_item", "A.1 Doors", 1, 70, 680),
        item("page_header", "running", 1, 70, 790),
        item("list_item", "first", 1, 70, 600, marker="a)"),
        item("list_item", "nested", 1, 84, 580, marker="1."),
        item("list_item", "second", 2, 70, 700, marker="b)"),
        item("section_header", "A.1.2 Handles", 2, 70, 600),
        item("section_header", "No number", 2, 70, 580),
        item("text", "leaf text", 2, 70, 560),
        item("section_header", "A.1.2 Handles", 2, 70, 540),
        item("text", "in figure", 2, 310, 395),
        item("caption", "Figure 1", 2, 310, 370),
        item("text", "DOG Núm. 12", 2, 70, 20),
        item("text", "  ", 2, 70, 30),
        {"label": "text", "text": "no place"},
    ],
    "tables": [{"prov": [{"page_no": 3, "bbox": box(50, 500, 300, 400)}], "captions": [{"text": "4.1 Sizes"}], "data": {"num_rows": 2, "num_cols": 2, "table_cells": [{"start_row_offset_idx": 0, "start_col_offset_idx": 1, "text": "x"}, {"start_row_offset_idx": 0, "start_col_offset_idx": 1, "text": "y"}, {"start_row_offset_idx": 1, "text": "z"}]}}],
    "pictures": [{"prov": [{"page_no": 2, "bbox": box(300, 400, 500, 300)}]}, {"prov": [{"page_no": 2, "bbox": box(0, 800, 600, 0)}], "captions": [{"text": "Plan"}]}],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("layout")
    (d / "My-Doc.json").write_text(json.dumps(DOC))
    return str(d)


def test_records(spark, folder):
    items = layout.items(layout.read_layout(spark, folder).filter("doc = 'My-Doc'"))
    r = ingest.build(items).cache()
    got = {x.id: x for x in r.collect()}
    assert got["MYD:p1:anejoA"].parent_id == "" and got["MYD:p1:A.1"].parent_id == "MYD:p1:anejoA"
    assert got["MYD:p1:A.1"].label == "section_header"  # promoted
    assert got["MYD:p1:§1"].parent_id == "MYD:p1:A.1" and got["MYD:p1:§1"].norm == "body of a.1 in 30 m2"
    assert got["MYD:p1:A.1.a"].parent_id == "MYD:p1:A.1" and got["MYD:p1:A.1.a.1"].parent_id == "MYD:p1:A.1.a"
    assert got["MYD:p2:A.1.b"].parent_id == "MYD:p1:A.1"  # the list goes on over the page
    assert got["MYD:p2:A.1.2"].parent_id == "MYD:p1:A.1" and got["MYD:p2:A.1.2~2"].parent_id == "MYD:p1:A.1"
    leaf = next(x for x in got.values() if x.text == "leaf text")
    assert got[leaf.parent_id].text == "No number" and got[leaf.parent_id].parent_id == "MYD:p2:A.1.2"
    assert not {"in figure", "running", "no place"} & {x.text for x in got.values()} and "Figure 1" in {x.text for x in got.values()}
    assert got["MYD:p3:4.1"].text == " | y ¶ z | " or got["MYD:p3:4.1"].text == "| y ¶ z |"
    order = [x.id for x in sorted(got.values(), key=lambda x: x.seq)]
    assert order.index("MYD:p1:anejoA") < order.index("MYD:p1:A.1") < order.index("MYD:p1:§1")
    counts = {x.what: x.n for x in ingest.tally(items).collect()}
    assert counts["furniture"] == 1 and counts["figure_labels"] == 1 and counts["empty"] == 1 and counts["running_header"] == 1
    prov = ingest.provenance(layout.page_counts(layout.read_layout(spark, folder)).filter("doc = 'My-Doc'"), spark.createDataFrame([("My-Doc", 2, 2)], "doc string, page_from int, page_to int"))
    assert sorted((x.page_from, x.page_to, x.source) for x in prov.collect()) == [(1, 1, "native"), (2, 2, "ocr"), (3, 3, "native")]
    assert [tuple(x) for x in checks.failures(r, prov).collect()] == [("picture_texts", 1)]  # the caption of a picture is its text, which the gate tells
    again = ingest.build(items)
    assert checks.fingerprint(r).first() == checks.fingerprint(again).first()


def test_files(spark, folder, tmp_path):
    r = ingest.build(layout.items(layout.read_layout(spark, folder).filter("doc = 'My-Doc'"))).cache()
    tsv.write_tsv(r, f"{tmp_path}/corpus", tsv.RECORDS, ["doc", "seq"])
    back = tsv.load(spark, f"{tmp_path}/corpus")
    assert [x[1:] for x in back.orderBy("seq").collect()] == [x[1:] for x in r.orderBy("seq").collect()]
    bad = tmp_path / "bad.tsv"
    bad.write_text("\t".join(tsv.RECORDS) + "\nonly\ttwo\n")
    with pytest.raises(Exception, match="number of fields"):
        tsv.read_tsv(spark, str(bad), tsv.RECORDS).collect()
    bad.write_text("a\tb\n")
    with pytest.raises(tsv.CorpusError):
        tsv.read_tsv(spark, str(bad), tsv.RECORDS)
    line = "x:p1:1\tx\t1\t\t\ttext\ta \"q\n"[:-1] + "\ta \"q\n"
    bad.write_text("\t".join(tsv.RECORDS) + "\n" + line + line)
    with pytest.raises(tsv.CorpusError):
        tsv.load(spark, str(bad))
    out = f"{tmp_path}/out"
    assert tsv.promote(r, out, lambda x: checks.failures(x).filter("gate <> 'picture_texts'")) and tsv.current(spark, out).count() == r.count()
    assert not tsv.promote(r.limit(1), out, lambda x: x) and tsv.current(spark, out).count() == r.count()  # the old version stays
    assert tsv.promote(r.limit(1), out, lambda x: x, accept=True) and tsv.current(spark, out).count() == 1


def test_stream(spark, folder, tmp_path):
    import shutil

    inbox, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"
    shutil.copytree(folder, inbox)
    arrivals.follow(spark, str(inbox), out, check).awaitTermination()
    first = arrivals.arrived(spark, out).filter("doc = 'MYD'").count()
    assert first > 10 and arrivals.compact(spark, out).filter("doc = 'MYD'").count() == first
    shutil.copy(inbox / "My-Doc.json", inbox / "Next.json")
    arrivals.follow(spark, str(inbox), out, check).awaitTermination()
    assert arrivals.arrived(spark, out).filter("doc = 'NEX'").count() == first and arrivals.arrived(spark, out).filter("doc = 'MYD'").count() == first
    assert arrivals.compact(spark, out).count() == arrivals.arrived(spark, out).count() >= 2 * first


def test_numbered_items_hold_whole_lines(spark, tmp_path):
    """Lines of all kinds, short and long, about the length that makes a heading of a numbered list item: every text ends as its line does, and the SQL gives the same rows."""
    duckdb = pytest.importorskip("duckdb")
    line = lambda doc, pos: "palabra 😀 " * ((doc + pos) % 9) + "x" * (pos % 7) + f" fin{doc}y{pos}"
    docs = [(doc, "\n".join(line(doc, pos) for pos in range(60))) for doc in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = "seq, id, doc, page, cite, parent_id, label, text"
    got = sorted(map(tuple, catalogue.QUERIES["ingest_numbered"](spark, str(tmp_path)).select(*columns.split(", ")).collect()))
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({catalogue.ORACLES['ingest_numbered']})").fetchall())
    assert len(got) == 40 * 60 and all(x[-1].endswith(f" fin{int(x[2], 36)}y{x[0]}") for x in got)
    disguised = {(x[-2], len(x[-1])) for x in got if x[-1].startswith("A.1.3 Rótulo ")}
    assert {"section_header"} == {label for label, n in disguised if n <= 100} and {"list_item"} == {label for label, n in disguised if n > 100}


@pytest.mark.parametrize("few", [100_000, 0])
def test_few_flags_shuffle_no_texts(spark, monkeypatch, few):
    """Items in figures and tables are told by flags that go to the items, or by a join if these are many; the same ones are dropped."""
    monkeypatch.setattr(ingest, "FEW", few)
    places = {"caption": (60, 690), "figure": (60, 650), "cell": (60, 450), "outside": (60, 100)}
    doc = {
        "texts": [item("caption" if t == "caption" else "text", t, 1, *at) for t, at in places.items()], "tables": [{"label": "table", "prov": [{"page_no": 1, "bbox": box(50, 500, 300, 400)}]}],
        "pictures": [{"label": "picture", "prov": [{"page_no": 1, "bbox": box(50, 700, 300, 600)}]}], "pages": {"1": {"size": {"width": 600.0, "height": 800.0}}},
    }
    rows = spark.read.schema(layout.SCHEMA).json(spark.sparkContext.parallelize([json.dumps(doc)])).withColumn("doc", F.lit("A"))
    x = ingest.prepared(layout.items(rows))
    assert {(r.body, r.dropped) for r in x.filter("kind = 'text'").collect()} == {("caption", None), ("figure", "figure_labels"), ("cell", "in_table"), ("outside", None)}
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning" in plan) == ("SortMergeJoin" in plan) and (few == 0 or "Exchange hashpartitioning" not in plan)
