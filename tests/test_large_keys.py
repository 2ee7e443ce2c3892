"""Queries against their SQL on tables of few rows whose keys are those of large tables: documents and pages beyond 36^3, parts beyond a million."""

import pytest

from foliant import queries as catalogue

duckdb = pytest.importorskip("duckdb")


def shown(x):
    return "" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    for f in d.iterdir():
        con.execute(f"CREATE VIEW {f.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = sorted(tuple(map(shown, r)) for r in want.fetchall())
    assert rows and sorted(tuple(map(shown, r)) for r in catalogue.QUERIES[name](spark, str(d)).select(*columns).collect()) == rows


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    """In base 36 the numbers from 46656 on have four places, of which the first three are those of 1296."""
    d = tmp_path_factory.mktemp("documents")
    text = "'line ' || i || chr(10) || 'b' || chr(10) || 'c d'"
    duckdb.execute(f"COPY (SELECT i AS doc_id, {text} AS text FROM (SELECT unnest([1, 1296, 46656, 46657, 46691, 120000]) AS i)) TO '{d}/documents.parquet'")
    return d


@pytest.mark.parametrize("name", ["ingest_cites", "markers", "ingest_numbered", "layout_round_trip"])
def test_numbers_of_documents(spark, documents, name):
    same_as_sql(spark, documents, name)


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Pages of documents 1, 1296, 46656 and 46657, with parts on both sides of a million: n, ten times a part, then passes ten million."""
    d = tmp_path_factory.mktemp("lines")
    pages = "SELECT p + j AS p FROM (SELECT unnest([50, 64800, 2332800, 2332850]) AS p), range(50) r(j)"
    some = f"SELECT p, (p * 7919 + i * 611953) % 3000000 AS k, i % 7 AS n FROM ({pages}), range(16) q(i)"
    # beginnings of lines: of two words a pixel apart the left one has a number two millions higher (13 * 1077 is 1 modulo 2000, so k stands at x)
    heads = "SELECT p, 1077 * x % 2000 + m AS k, i AS n FROM (SELECT p, i, 200 + (p * 7 + i * 13) % 100 + e AS x, 2000000 * (1 - e) AS m FROM range(1000, 1400) r(p), range(6) q(i), range(2) s(e))"
    duckdb.execute(f"COPY (SELECT CAST(p AS BIGINT) AS l_orderkey, CAST(k AS BIGINT) AS l_partkey, CAST(n AS BIGINT) AS l_linenumber FROM ({some} UNION ALL {heads})) TO '{d}/lineitem.parquet'")
    return d


@pytest.mark.parametrize("name", ["ingest_records", "ingest_counters", "ingest_dispositions", "ingest_tally", "gutter_markers", "marker_continuity", "ocr_line_heads"])
def test_numbers_of_pages_and_parts(spark, lines, name):
    same_as_sql(spark, lines, name)


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Neighbouring pages of one document whose parts are ten million apart: page * 100000000 + n is the same for boxes of both."""
    d = tmp_path_factory.mktemp("parts")
    some = "SELECT 100 + j AS p, (i * 7919) % 400 + 10000000 * (5 - j) AS k, i % 7 AS n FROM range(6) r(j), range(200) q(i) WHERE (i + j) % 3 > 0"
    duckdb.execute(f"COPY (SELECT CAST(p AS BIGINT) AS l_orderkey, CAST(k AS BIGINT) AS l_partkey, CAST(n AS BIGINT) AS l_linenumber FROM ({some})) TO '{d}/lineitem.parquet'")
    return d


@pytest.mark.parametrize("name", ["ingest_counters", "ingest_dispositions", "ingest_tally", "ingest_records"])
def test_parts_beyond_ten_million(spark, parts, name):
    same_as_sql(spark, parts, name)
