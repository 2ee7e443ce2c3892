"""The stages in a row, on a small fixture and on odd input."""

import random

import corpus_pipeline as cp
from foliant.llm import queries

random.seed(5)
V = [f"v{i}" for i in range(40)]  # few words: a small corpus shows most of their pairs


def test_pipeline(spark, tmp_path):
    text = lambda n=60: " ".join(random.choice(V) for _ in range(n))
    clean = [(i, text()) for i in range(120)]
    toxic = [(200 + i, text() + " grumble snarl grumble") for i in range(60)]
    junk = [(300 + i, " ".join(random.choice(V) + "###" for _ in range(60))) for i in range(20)]
    near = [(400 + i, clean[i][1] + " tail") for i in range(5)] + [(410, clean[7][1])]
    item = text(30)
    leaks = [(500, text() + " " + item + " " + text()), (501, text() + " " + " ".join(item.split()[5:18]))]
    rows = clean + toxic + junk + near + leaks + [(600, None), (601, ""), (None, text())]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = cp.run(spark, str(tmp_path)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == [-1, *range(120)]
    assert all(r.decoded == r.text and r.piece_ids[-1] == 2 for r in kept)


def test_stages_keep_columns_and_pass_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string, score int, __j_doc long, toxic string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0


def test_near_copies_are_dropped_by_row(spark, tmp_path):
    """Rows without an id, and rows of one id with different texts, are told apart; a copy beside a unique text of its id goes alone."""
    t = [" ".join(f"{a}{k}" for k in range(40)) for a in "abcdefgh"]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (9, t[5]), (8, t[3] + " more"), (7, t[6]), (10, t[6]), (11, t[0]), (12, t[7]), (12, t[7]), (None, ""), (None, None), (12, t[7].upper())]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `a.b` int")
    kept = cp.drop_near_copies(spark, docs, "").collect()
    seen = sorted((str(r.doc_id), r.text or "") for r in kept)
    twelve = [r for r in kept if r.doc_id == 12]
    assert len(twelve) == 1 and twelve[0].text.lower() == t[7]
    assert [x for x in seen if x[0] != "12"] == sorted([("None", t[1]), ("None", t[2]), ("7", t[3]), ("7", t[4]), ("9", t[5]), ("7", t[6]), ("11", t[0]), ("None", ""), ("None", "")])


def test_stages_take_any_column_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words of a text that is long enough to be kept", 5)], "doc_id long, text string, `a.b` int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert cp.encode(spark, docs, "").columns[:3] == docs.columns


def test_every_operator_has_its_query():
    assert {int(q[2:].split("_")[0]) for q in queries.Q} == set(range(1, 11))
