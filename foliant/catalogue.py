"""The named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import analytics as A
from .operators import checks as C
from .operators import geometry as G
from .operators import order as R
from .operators import search as S
from .plans import carriers as P
from .storage import ranked as numbered

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def ranked_sql(terms: list[str], extra: str = "") -> str:
    flag = lambda t: f"regexp_matches(norm, '(^|[^\\p{{L}}\\p{{N}}_]){t}')"
    score = " + ".join(f"max(CAST({flag(t)} AS INTEGER))" for t in terms)
    hit = " OR ".join(map(flag, terms))
    return f"""WITH {P.SQL_DOCS},
hits AS (SELECT CASE WHEN parent_id = '' THEN id ELSE parent_id END AS section_id, * EXCLUDE (parent_id), parent_id FROM records WHERE norm <> '' AND ({hit})),
scored AS (SELECT section_id, {score} AS score, coalesce(string_agg(CASE WHEN parent_id <> '' THEN id END, '|' ORDER BY seq), '') AS children FROM hits GROUP BY section_id),
found AS (SELECT s.score, r.seq, r.doc, r.page, s.section_id, s.children, row_number() OVER (ORDER BY s.score DESC, r.seq) AS rank FROM scored s JOIN records r ON r.id = s.section_id WHERE s.score >= 2)
SELECT {extra or 'rank, score, doc, page, section_id, children'} FROM found"""


def ranked(spark: SparkSession, d: str, terms: list[str]) -> DataFrame:
    rows = numbered(S.search_indexed(P.term_index(spark, d), P.rec_docs(spark, d), terms), F.desc("score"), "seq")
    return rows.select("rank", "score", "doc", "page", "section_id", F.array_join("children", "|").alias("children"))


TERMS = ["the", "ion", "er"]


@query(ranked_sql(TERMS))
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, TERMS)


@query(ranked_sql(TERMS))
def search_scanned(spark, d):
    """The same answer without postings: one scan of all norms."""
    records = P.corpus(spark, d)
    heads = records.select(F.col("id").alias("section_id"), "seq", "doc", "page")
    rows = numbered(S.section_scores(records, TERMS).join(heads, "section_id"), F.desc("score"), "seq")
    return rows.select("rank", "score", "doc", "page", "section_id", F.array_join("children", "|").alias("children"))


@query(ranked_sql(["thre", "thre"]))
def search_dup_terms(spark, d):
    return ranked(spark, d, ["Thré", "thre"])


@query("SELECT 0 AS rank, 0 AS score, '' AS doc, 0 AS page, '' AS section_id, '' AS children WHERE false")
def search_single_term_empty(spark, d):
    return ranked(spark, d, ["the"])


@query(ranked_sql(["th\\.", "er\\."]))
def search_metachar(spark, d):
    return ranked(spark, d, ["th.", "er."])


@query(f"WITH RECURSIVE {P.SQL_HIER} SELECT id, coalesce(string_agg(t, ' > ' ORDER BY distance DESC), '') AS chain FROM (SELECT up.id, up.distance, h.text AS t FROM up JOIN hier h ON h.id = up.ancestor_id WHERE up.id LIKE 'H:p1:C%') GROUP BY id")
def ancestor_chain(spark, d):
    h = P.hier_corpus(spark, d)
    ids = h.filter("id LIKE 'H:p1:C%'").select("id")
    return S.chain_texts(ids, S.ancestry(h, ids=ids), h).select("id", F.array_join("ancestors", " > ").alias("chain"))


@query(f"WITH RECURSIVE {P.SQL_HIER_LINES} SELECT up.id, string_agg(h.text, ' > ' ORDER BY distance DESC) AS chain FROM up JOIN hier h ON h.id = up.ancestor_id GROUP BY up.id")
def ancestor_chain_all(spark, d):
    """Line items have nothing under them."""
    return S.all_chains(P.hier_lines(spark, d), P.hier(spark, d)).select("id", F.array_join("ancestors", " > ").alias("chain"))


@query(f"WITH RECURSIVE {P.SQL_HIER} SELECT id, CAST(max(distance) AS INTEGER) AS depth FROM up GROUP BY id")
def depth(spark, d):
    return S.roots(P.hier_corpus(spark, d)).filter("depth > 0").select("id", F.col("depth").cast("int").alias("depth"))


@query(f"WITH {P.SQL_DOCS}, lined AS (SELECT id, row_number() OVER (ORDER BY seq) - 1 AS g FROM records) SELECT id, first_value(id) OVER (PARTITION BY g // {P.LEVELS} ORDER BY g) AS root, g % {P.LEVELS} AS depth FROM lined")
def chain_roots(spark, d):
    """Chains of ten thousand levels: where each ends, and how deep each record stands."""
    return S.roots(P.line_chain(spark, d))


@query(f"WITH {P.SQL_DOCS}, lined AS (SELECT id, row_number() OVER (ORDER BY seq) - 1 AS g FROM records), last AS (SELECT arg_max(id, g) AS id, max(g) % {P.LEVELS} AS n, max(g) AS g FROM lined GROUP BY g // {P.LEVELS}) SELECT last.id, x.id AS ancestor_id, CAST(last.g - x.g AS INTEGER) AS distance FROM last JOIN lined x ON x.g < last.g AND x.g // {P.LEVELS} = last.g // {P.LEVELS}")
def chain_ancestors(spark, d):
    """All that stands above the last record of each chain."""
    rows = P.line_chain(spark, d)
    above = rows.select(F.col("parent_id").alias("id")).distinct()
    return S.ancestry(rows, ids=rows.join(above, "id", "left_anti").select("id"))


@query(f"WITH RECURSIVE {P.SQL_HIER} SELECT up.id, arg_min(up.ancestor_id, up.distance) AS header_id FROM up JOIN hier h ON h.id = up.ancestor_id WHERE h.label = 'section_header' GROUP BY up.id")
def governing_header(spark, d):
    h = P.hier_corpus(spark, d)
    heads = h.filter("label = 'section_header'").select(F.col("id").alias("ancestor_id"))
    return S.ancestry(h).join(heads, "ancestor_id").groupBy("id").agg(F.min_by("ancestor_id", "distance").alias("header_id"))


_TREE = """WITH t AS (SELECT 'H:p1:R' || r_regionkey AS id, r_regionkey AS r, NULL AS n, NULL AS c, NULL AS o FROM region UNION ALL SELECT 'H:p1:N' || n_nationkey, n_regionkey, n_nationkey, NULL, NULL FROM nation
 UNION ALL SELECT 'H:p1:C' || c_custkey, n_regionkey, n_nationkey, c_custkey, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT 'H:p1:O' || o_orderkey, n_regionkey, n_nationkey, c_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT *, row_number() OVER (ORDER BY r, n NULLS FIRST, c NULLS FIRST, o NULLS FIRST) AS pre FROM t)"""


@query(_TREE + " SELECT id, pre, CASE WHEN n IS NULL THEN max(pre) OVER (PARTITION BY r) WHEN c IS NULL THEN max(pre) OVER (PARTITION BY r, n) WHEN o IS NULL THEN max(pre) OVER (PARTITION BY r, n, c) ELSE pre END AS last FROM p")
def order_labels(spark, d):
    return P.hier_labels(spark, d)


@query(f"WITH RECURSIVE {P.SQL_HIER} SELECT id FROM up WHERE ancestor_id = 'H:p1:N3'")
def descends_from(spark, d):
    return R.under(P.hier_labels(spark, d), "H:p1:N3").select("id")


GET = ["H:p1:N3", "H:p1:R1,R0", "nope", "H:p1:N3", "x,y"]


def _got(spark, d):
    h = P.hier_corpus(spark, d)
    return S.get(h, GET)


@query(f"""WITH RECURSIVE {P.SQL_HIER},
asked(ask, part, id) AS (VALUES (0, 0, 'H:p1:N3'), (1, 0, 'H:p1:R1'), (1, 1, 'H:p1:R0'), (3, 0, 'H:p1:N3')),
chain AS (SELECT up.id, string_agg(h.text, ' > ' ORDER BY distance DESC) AS chain FROM up JOIN hier h ON h.id = up.ancestor_id GROUP BY up.id),
kids AS (SELECT parent_id, count(*) AS children, min(id) AS first_child FROM hier WHERE parent_id <> '' GROUP BY parent_id)
SELECT ask, part, a.id, h.text, coalesce(chain, '') AS chain, CAST(coalesce(children, 0) AS INTEGER) AS children, first_child FROM asked a JOIN hier h ON h.id = a.id LEFT JOIN chain c ON c.id = a.id LEFT JOIN kids k ON k.parent_id = a.id""")
def get_records(spark, d):
    return _got(spark, d)[0].select("ask", "part", "id", "text", F.array_join("ancestors", " > ").alias("chain"), F.size("children").alias("children"), F.array_min(F.transform("children", lambda x: x["id"])).alias("first_child"))


@query("SELECT * FROM (VALUES (2, 0, 'nope'), (4, 0, 'x,y')) AS t(ask, part, id)")
def get_unknown_ids(spark, d):
    return _got(spark, d)[1]


@query(f"WITH {P.SQL_DOCS} SELECT r.seq, r.id, r.doc, r.page, coalesce(p.text, '') AS ancestors FROM records r LEFT JOIN records p ON p.id = r.parent_id WHERE r.cite = 'A.3'")
def get_by_cite_all(spark, d):
    return S.get_by_cite(P.corpus(spark, d), "A.3").withColumn("ancestors", F.array_join("ancestors", " > "))


@query(f"WITH {P.SQL_DOCS} SELECT r.seq, r.id, r.doc, r.page, coalesce(p.text, '') AS ancestors FROM records r LEFT JOIN records p ON p.id = r.parent_id WHERE r.cite = 'A.3' AND r.doc = 'D2'")
def get_by_cite_doc(spark, d):
    return S.get_by_cite(P.corpus(spark, d), "A.3", "D2").withColumn("ancestors", F.array_join("ancestors", " > "))


@query(f"WITH {P.SQL_DOCS} SELECT seq, id, label, text FROM records WHERE doc = 'D2' AND page = 1")
def get_page(spark, d):
    r = P.corpus(spark, d)
    return S.get_page(r, P.prov(r), "D2", 1)


@query(f"WITH {P.SQL_DOCS}, {P.SQL_PROV} SELECT doc, CAST(max(page_to) AS INTEGER) AS pages FROM prov GROUP BY doc")
def page_bounds(spark, d):
    return S.doc_pages(P.prov(P.rec_docs(spark, d, False)))


@query(f"WITH {P.SQL_DOCS} SELECT min(seq) AS first, 'D' || doc_id || ':p' || page || ':' || string_agg('§' || (pos % 10 + 1), ',' ORDER BY seq) AS compact FROM (SELECT r.seq, r.page, r.seq // 1000000 AS doc_id, r.seq % 1000000 AS pos FROM records r) GROUP BY doc_id, page")
def wire_ids(spark, d):
    return S.group_ids(P.rec_docs(spark, d, False).select(F.col("seq").alias("pos"), "id"))


@query(f"WITH {P.SQL_DOCS} SELECT id, norm FROM records")
def norm_text(spark, d):
    return P.rec_docs(spark, d).select("id", "norm")


@query(f"WITH {P.SQL_DOCS} SELECT id, replace(text, '><', '×') AS fixed FROM records")
def repair_text(spark, d):
    r = P.rec_docs(spark, d, False)
    return r.select("id", X.repair(F.col("text")).alias("fixed"))


_NUMBERED = "CASE seq % 5 WHEN 0 THEN 'Artículo ' || (seq % 90) || '. ' || text WHEN 1 THEN 'B.' || (seq % 9) || '.2 ' || text WHEN 2 THEN (seq % 30) || '.1 ' || text WHEN 3 THEN 'Sección SUA ' || (seq % 7) || ' ' || text ELSE text END"


_PARSED = f"""m AS (SELECT id,
 regexp_extract(t, '(?i)^(Anejo\\s+[A-Z]|Secci[oó]n\\s+[A-Z]*\\s*[0-9]+|Cap[ií]tulo\\s+[IVXLC0-9]+|T[ií]tulo\\s+[IVXLC0-9]+)([^\\p{{L}}\\p{{N}}_]|$)', 1) AS a,
 regexp_extract(t, '(?i)^(Art[ií]culo\\s+[0-9]+)([^\\p{{L}}\\p{{N}}_]|$)', 1) AS b,
 regexp_extract(t, '^([A-Z]\\.[0-9]+(\\.[0-9]+)*)\\.?([\\s.]|$)', 1) AS c, regexp_extract(t, '^([0-9]+(\\.[0-9]+)*)\\.?(\\s|$)', 1) AS e FROM s)
SELECT id, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN c <> '' THEN c WHEN e <> '' THEN e END AS cite,
 CASE WHEN a <> '' OR b <> '' THEN 'ns' WHEN c <> '' OR e <> '' THEN 'num' END AS kind, CASE WHEN a <> '' THEN 1 WHEN b <> '' THEN 2 END AS rank FROM m"""


@query(f"WITH {P.SQL_DOCS}, s AS (SELECT id, text AS t FROM records), {_PARSED}")
def parse_cite(spark, d):
    """Cites that lines of documents bear as they are."""
    return P.corpus(spark, d).select("id", X.parse_cite(F.col("text")).alias("c")).select("id", "c.cite", "c.kind", "c.rank")


@query(f"WITH {P.SQL_DOCS}, s AS (SELECT id, {_NUMBERED} AS t FROM records), {_PARSED}")
def parse_cite_documents(spark, d):
    """Lines of documents, four of five with a planted cite before them."""
    r = P.rec_docs(spark, d, False).withColumn("t", F.expr(_NUMBERED))
    return r.select("id", X.parse_cite(F.col("t")).alias("c")).select("id", "c.cite", "c.kind", "c.rank")


_PRINTED = "CASE seq % 6 WHEN 0 THEN 'Artículo ' || (seq % 90) || '.1.a)' WHEN 1 THEN 'Sección SUA ' || (seq % 7) WHEN 2 THEN 'B.' || (seq % 9) || '.6' WHEN 3 THEN 'Capítulo II' WHEN 4 THEN 'TÍTULO III' ELSE 'anejo A' END"


@query(f"WITH {P.SQL_DOCS} SELECT id, CASE seq % 6 WHEN 0 THEN 'art' || (seq % 90) || '.1.a' WHEN 1 THEN 'secSUA' || (seq % 7) WHEN 2 THEN 'B.' || (seq % 9) || '.6' WHEN 3 THEN 'capII' WHEN 4 THEN 'titIII' ELSE 'anejoA' END AS path FROM records")
def cite_path(spark, d):
    """The part of an address that printed cites make, one planted for each line."""
    return P.corpus(spark, d).select("id", X.cite_path(F.expr(_PRINTED)).alias("path"))


@query("SELECT DISTINCT source, upper(substr(regexp_replace(source, '[^A-Za-z0-9]', '', 'g'), 1, 3)) AS code FROM documents")
def doc_code(spark, d):
    return P.read(spark, d, "documents").select("source", X.doc_code(F.col("source")).alias("code")).distinct()


@query(f"WITH {P.SQL_BOXES} SELECT page, n, row_number() OVER (PARTITION BY page ORDER BY round_even(-t / 4.0, 0), l, n) AS place FROM boxes")
def reading_order(spark, d):
    return G.reading_order(P.boxes(spark, d))


_IN = "x.page = o.page AND x.l >= o.l - 2 AND x.r <= o.r + 2 AND least(x.t, x.b) >= least(o.t, o.b) - 2 AND greatest(x.t, x.b) <= greatest(o.t, o.b) + 2"
_FIG = f"figs AS (SELECT * FROM boxes o WHERE kind = 'picture' AND NOT EXISTS (SELECT 1 FROM boxes x WHERE x.kind = 'text' AND x.label IN ('section_header', 'list_item') AND {_IN}))"


@query(f"WITH {P.SQL_BOXES}, {_FIG} SELECT page, n FROM figs")
def box_disqualify(spark, d):
    return G.true_figures(P.boxes(spark, d)).select("page", "n")


_DISP = f"""WITH {P.SQL_BOXES}, {_FIG}, disp AS (SELECT page, n, CASE WHEN label <> 'caption' AND EXISTS (SELECT 1 FROM figs o WHERE {_IN}) THEN 'figure_label'
 WHEN EXISTS (SELECT 1 FROM boxes o WHERE o.kind = 'table' AND {_IN}) THEN 'in_table' ELSE 'body' END AS disposition FROM boxes x WHERE kind = 'text')"""


@query(_DISP + " SELECT * FROM disp")
def figure_filter(spark, d):
    return G.disposition(P.boxes(spark, d))


@query(_DISP + " SELECT * FROM disp")
def crowded_page(spark, d):
    """All boxes of all pages side by side on one page: the same answers, from tiles."""
    room = 100_000_000
    b = P.boxes(spark, d)
    x, y = F.col("page") % 1000 * 3000.0, F.floor(F.col("page") / 1000) * 3000.0
    one = b.select(F.lit(0).alias("page"), (F.col("page") * room + F.col("n")).alias("n"), "kind", "label", *((F.col(c) + x).alias(c) for c in "lr"), *((F.col(c) + y).alias(c) for c in "tb"))
    return G.disposition(one).select(F.floor(F.col("n") / room).alias("page"), (F.col("n") % room).alias("n"), "disposition")


@query(f"WITH {P.SQL_DOCS} SELECT id, id AS source FROM records")
def crowded_ranges(spark, d):
    """One document with a range of three pages for each line of all documents: each line's page lies in its own."""
    lined = numbered(P.corpus(spark, d).select("id", "seq"), "seq", name="g", kind="long")
    spans = lined.select(F.lit("X").alias("doc"), (F.col("g") * 3).alias("page_from"), (F.col("g") * 3 + 2).alias("page_to"), F.col("id").alias("source"))
    pages = lined.select("id", F.lit("X").alias("doc"), (F.col("g") * 3 + F.col("g") % 3).alias("page"), F.lit("text").alias("label"))
    return C.with_source(pages, spans).select("id", "source")


@query(_DISP + " SELECT disposition, count(*) AS n FROM disp GROUP BY disposition")
def disposition_counts(spark, d):
    return G.disposition(P.boxes(spark, d)).groupBy("disposition").agg(F.count("*").alias("n"))


_NEAR = "i.page = m.page AND abs(i.t - m.t) <= 40 AND i.l - m.l > -60 AND i.l - m.l < 90"
_SIDES = f"{P.SQL_BOXES}, i AS (SELECT * FROM boxes WHERE label = 'list_item'), m AS (SELECT * FROM boxes WHERE label = 'text')"


def _sides(spark, d):
    b = P.boxes(spark, d)
    return b.filter("label = 'list_item'"), b.filter("label = 'text'"), 40.0, -60.0, 90.0


@query(f"WITH {_SIDES} SELECT page, n, mark FROM (SELECT i.page, i.n, m.n AS mark, row_number() OVER (PARTITION BY i.page, i.n ORDER BY abs(i.t - m.t), m.n) AS k FROM i JOIN m ON {_NEAR}) WHERE k = 1")
def nearest_marker(spark, d):
    return G.nearest(*_sides(spark, d))


@query(f"WITH {_SIDES} SELECT page, n FROM m WHERE NOT EXISTS (SELECT 1 FROM i WHERE {_NEAR})")
def orphan_markers(spark, d):
    return G.orphans(*_sides(spark, d)).select("page", "n")


@query("""WITH p AS (SELECT DISTINCT user_id AS k, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM events), g AS (SELECT *, CASE WHEN m - lag(m) OVER (PARTITION BY k ORDER BY m) <= 18 THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY m) AS run FROM g) SELECT k, CAST(run AS BIGINT) AS run, min(m) AS first, max(m) AS last, count(*) AS points FROM r GROUP BY k, run""")
def ink_runs(spark, d):
    e = P.read(spark, d, "events").select(F.col("user_id").alias("k"), F.floor(F.unix_timestamp("ts") / 60).cast("long").alias("at"))
    return G.runs(e, "k", "at", 18)


@query(f"""WITH {P.SQL_BOXES}, cells AS (SELECT DISTINCT page, unnest(range(CAST(l AS BIGINT), CAST(r AS BIGINT))) AS x FROM boxes WHERE kind = 'text'),
holes AS (SELECT DISTINCT page, unnest(range(CAST(l AS BIGINT), CAST(r AS BIGINT))) AS x FROM boxes WHERE kind = 'table'),
free AS (SELECT * FROM cells EXCEPT SELECT * FROM holes), g AS (SELECT page, x, x - row_number() OVER (PARTITION BY page ORDER BY x) AS run FROM free)
SELECT page, min(x) AS first, max(x) + 1 AS last FROM g GROUP BY page, run""")
def interval_subtract(spark, d):
    b = P.boxes(spark, d).select("page", "kind", F.col("l").cast("long").alias("first"), F.col("r").cast("long").alias("last"))
    return G.subtract(b.filter("kind = 'text'").drop("kind"), b.filter("kind = 'table'").drop("kind"), "page")


@query(f"WITH {P.SQL_BOXES} SELECT page, min(l) AS l, max(r) AS r, max(greatest(t, b)) AS t, min(least(t, b)) AS b FROM boxes WHERE kind = 'text' GROUP BY page")
def line_union(spark, d):
    b = P.boxes(spark, d).filter("kind = 'text'")
    return b.groupBy("page").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.max(F.greatest("t", "b")).alias("t"), F.min(F.least("t", "b")).alias("b"))


@query(f"WITH {P.SQL_DOCS}, {P.SQL_PROV} SELECT doc, CAST(page_from AS INTEGER) AS page_from, CAST(page_to AS INTEGER) AS page_to, source FROM prov")
def provenance_gap_fill(spark, d):
    r = P.rec_docs(spark, d, False)
    pages = r.groupBy("doc").agg(F.max("page").alias("n"))
    return A.gap_fill(P.prov(r).filter("source = 'ocr'"), pages)


@query(f"WITH {P.SQL_DOCS}, {P.SQL_PROV} SELECT r.id, v.source FROM records r LEFT JOIN prov v ON r.doc = v.doc AND r.page BETWEEN v.page_from AND v.page_to")
def provenance_join(spark, d):
    r = P.rec_docs(spark, d, False)
    return C.with_source(r, P.prov(r)).select("id", "source")


@query(f"WITH {P.SQL_DOCS}, {P.SQL_PROV}, bad AS (SELECT doc, CASE WHEN CAST(substr(doc, 2) AS BIGINT) % 5 = 1 THEN page_from + 1 ELSE page_from END AS page_from, page_to FROM prov), b AS (SELECT *, coalesce(lag(page_to) OVER (PARTITION BY doc ORDER BY page_from, page_to), 0) AS last FROM bad) SELECT doc, CAST(page_from AS INTEGER) AS page_from, CAST(page_to AS INTEGER) AS page_to FROM b WHERE page_from <> last + 1 OR page_to < page_from")
def provenance_contiguous(spark, d):
    """Ranges with planted gaps: those of every fifth document begin a page late."""
    late = F.substring("doc", 2, 18).cast("long") % 5 == 1
    return C.broken_ranges(P.prov(P.rec_docs(spark, d, False)).withColumn("page_from", F.col("page_from") + late.cast("int")))


@query(f"WITH {P.SQL_DOCS}, {P.SQL_PROV} SELECT r.id, (r.seq % 5 = 1 AND v.source = 'ocr') AS caveat FROM records r JOIN prov v ON r.doc = v.doc AND r.page BETWEEN v.page_from AND v.page_to")
def disclosure(spark, d):
    r = P.rec_docs(spark, d, False)
    tables = r.withColumn("label", F.when(F.col("seq") % 5 == 1, "table").otherwise(F.col("label")))
    return C.caveats(tables, P.prov(r))


def _faulty(spark, d):
    """Records with planted faults: a changed parent, a doubled id, a wrong norm, an empty text, a wrong page."""
    r = P.corpus(spark, d)
    k = F.col("seq") % 97
    lost = F.when((k == 5) & (F.col("parent_id") != ""), "D0:p1:§99").otherwise(F.col("parent_id"))
    r = r.withColumn("parent_id", lost).withColumn("norm", F.when(k == 7, F.concat("norm", F.lit("x"))).otherwise(F.col("norm")))
    r = r.withColumn("text", F.when(k == 9, "").otherwise(F.col("text"))).withColumn("doc", F.when(k == 11, "ZZ").otherwise(F.col("doc")))
    return r.withColumn("id", F.when((k == 13), F.lit("twin")).otherwise(F.col("id")))


_BAD = f"""WITH {P.SQL_DOCS}, bad AS (SELECT seq, CASE WHEN seq % 97 = 13 THEN 'twin' ELSE id END AS id, CASE WHEN seq % 97 = 11 THEN 'ZZ' ELSE doc END AS doc, page,
 CASE WHEN seq % 97 = 5 AND parent_id <> '' THEN 'D0:p1:§99' ELSE parent_id END AS parent_id, label, CASE WHEN seq % 97 = 9 THEN '' ELSE text END AS text, CASE WHEN seq % 97 = 7 THEN norm || 'x' ELSE norm END AS norm, norm AS good FROM records) """


@query(_BAD + "SELECT id, count(*) AS n FROM bad GROUP BY id HAVING count(*) > 1")
def check_unique(spark, d):
    return C.duplicate_ids(_faulty(spark, d))


@query(_BAD + "SELECT id, parent_id FROM bad b WHERE parent_id <> '' AND NOT EXISTS (SELECT 1 FROM bad p WHERE p.id = b.parent_id)")
def check_parent(spark, d):
    return C.missing_parents(_faulty(spark, d))


@query(_BAD + "SELECT c.id, c.parent_id FROM bad c JOIN bad p ON p.id = c.parent_id WHERE c.doc <> p.doc")
def check_boundary(spark, d):
    return C.foreign_parents(_faulty(spark, d))


_MOVED = f"WITH {P.SQL_DOCS}, moved AS (SELECT * EXCLUDE (parent_id, seq, page), CASE WHEN seq % 1000000 = 0 AND (seq // 1000000) % 4 = 1 THEN seq + 3 ELSE seq END AS seq, CASE WHEN seq % 1000000 = 0 AND (seq // 1000000) % 4 = 2 THEN 2 ELSE page END AS page, parent_id FROM records) "


def _moved(spark, d):
    """Records whose roots stand after their first children in every fourth document, and a page later in another fourth."""
    root, doc = F.col("seq") % 1_000_000 == 0, F.floor(F.col("seq") / 1_000_000) % 4
    r = P.rec_docs(spark, d, False)
    return r.withColumn("page", F.when(root & (doc == 2), 2).otherwise(F.col("page"))).withColumn("seq", F.when(root & (doc == 1), F.col("seq") + 3).otherwise(F.col("seq")))


@query(_MOVED + "SELECT c.id, c.parent_id FROM moved c JOIN moved p ON p.id = c.parent_id WHERE p.seq >= c.seq")
def check_parent_order(spark, d):
    return C.late_parents(_moved(spark, d))


@query(_MOVED + "SELECT c.id, c.parent_id FROM moved c JOIN moved p ON p.id = c.parent_id WHERE p.page > c.page")
def check_page_order(spark, d):
    return C.later_page_parents(_moved(spark, d))


@query(_BAD + "SELECT id FROM bad WHERE NOT starts_with(id, doc || ':p' || page || ':')")
def check_ids(spark, d):
    return C.odd_ids(_faulty(spark, d))


@query(f"WITH {P.SQL_DOCS}, w AS (SELECT DISTINCT doc, 'text' AS label, 5 AS least FROM records UNION ALL SELECT 'Q', 'table', 1) SELECT w.doc, w.label, count(r.id) AS n, count(r.id) >= min(w.least) AS ok FROM w LEFT JOIN records r ON r.doc = w.doc AND r.label = w.label GROUP BY w.doc, w.label")
def check_bands(spark, d):
    r = P.rec_docs(spark, d, False)
    want = r.select("doc").distinct().select("doc", F.lit("text").alias("label"), F.lit(5).alias("least")).unionByName(spark.createDataFrame([("Q", "table", 1)], "doc string, label string, least int"))
    return C.bands(r, want)


@query("SELECT true AS same, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)")
def check_rebuild(spark, d):
    """Two builds of the records, one stored and one dealt otherwise, have one fingerprint."""
    a, b = C.fingerprint(P.corpus(spark, d)), C.fingerprint(P.rec_docs(spark, d).repartition(3))
    return a.join(b.select(F.col("n").alias("m"), F.col("x").alias("y"), F.col("s").alias("t"))).select(((F.col("x") == F.col("y")) & (F.col("s") == F.col("t")) & (F.col("n") == F.col("m"))).alias("same"), "n")


@query(f"WITH {P.SQL_DOCS}, lined AS (SELECT id, row_number() OVER (ORDER BY seq) - 1 AS g FROM records) SELECT id FROM lined WHERE g // {P.LEVELS} % 2 = 0")
def check_cycle(spark, d):
    """Chains of ten thousand levels, every other one closed to a ring: its first record stands under its last."""
    rows = P.line_chain(spark, d)
    lined = numbered(rows, "seq", name="n", kind="long").withColumn("chain", F.floor((F.col("n") - 1) / P.LEVELS))
    last = lined.groupBy("chain").agg(F.max_by("id", "n").alias("last"))
    ring = (F.col("parent_id") == "") & (F.col("chain") % 2 == 0)
    return C.cycles(lined.join(last, "chain").select("seq", "id", F.when(ring, F.col("last")).otherwise(F.col("parent_id")).alias("parent_id")))


@query("SELECT 'D' || doc_id || ':p1:§' || unnest([1, 2]) AS id FROM documents WHERE doc_id % 3 = 0 AND contains(text, chr(10)) UNION ALL SELECT 'H:p1:R0' UNION ALL SELECT 'H:p1:N' || min(n_nationkey) FROM nation WHERE n_regionkey = 0")
def check_cycle_records(spark, d):
    """Documents and the hierarchy with planted cycles: roots under their second line, a region under its first nation."""
    r, h = P.rec_docs(spark, d, False).select("seq", "id", "parent_id"), P.hier(spark, d).select("seq", "id", "parent_id")
    first = P.read(spark, d, "nation").filter("n_regionkey = 0").agg(F.concat(F.lit("H:p1:N"), F.min("n_nationkey")).alias("first"))
    root = (F.col("parent_id") == "") & (F.floor(F.col("seq") / 1_000_000) % 3 == 0)
    r = r.withColumn("parent_id", F.when(root, F.regexp_replace("id", "§1$", "§2")).otherwise(F.col("parent_id")))
    h = h.crossJoin(F.broadcast(first)).select("seq", "id", F.when(F.col("id") == "H:p1:R0", F.col("first")).otherwise(F.col("parent_id")).alias("parent_id"))
    return C.cycles(r.union(h))


@query(_BAD + "SELECT id FROM bad WHERE CASE WHEN text = '' THEN norm <> '' ELSE norm <> good END")
def check_norm(spark, d):
    return C.wrong_norms(_faulty(spark, d))


@query(_BAD + ", pic AS (SELECT id, CASE WHEN seq % 97 IN (9, 21, 23) AND seq % 2 = 0 THEN 'picture' ELSE label END AS label, text FROM bad) SELECT id, label FROM pic WHERE (text = '') <> (label = 'picture')")
def check_picture(spark, d):
    """Planted faults both ways: empty texts that are no pictures, and pictures with a text."""
    k = F.col("seq") % 97
    r = _faulty(spark, d)
    return C.picture_texts(r.withColumn("label", F.when(k.isin(9, 21, 23) & (F.col("seq") % 2 == 0), "picture").otherwise(F.col("label"))))


@query(f"WITH {P.SQL_DOCS}, {P.SQL_PROV} SELECT id, CAST(0 AS BIGINT) AS n FROM records r WHERE NOT EXISTS (SELECT 1 FROM prov v WHERE r.doc = v.doc AND v.source = 'native' AND r.page BETWEEN v.page_from AND v.page_to)")
def check_page_range(spark, d):
    r = P.rec_docs(spark, d, False)
    return C.uncovered_pages(r, P.prov(r).filter("source = 'native'"))


@query("SELECT 'D' || doc_id AS doc, 'unexpected' AS what FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'Q', 'missing'")
def check_roster(spark, d):
    r = P.rec_docs(spark, d, False)
    want = r.select("doc").filter(F.substring("doc", 2, 18).cast("long") % 10 != 0).distinct().unionByName(spark.createDataFrame([("Q",)], "doc string"))
    return C.roster(r, want)


_W = "[a-záéíóúüñ]{5,}"
_TF = f"""WITH {P.SQL_DOCS}, t AS (SELECT doc, CASE WHEN parent_id = '' THEN id ELSE parent_id END AS section_id, unnest(regexp_extract_all(norm, '{_W}')) AS term FROM records),
tf AS (SELECT doc, section_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT doc, term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT doc, count(DISTINCT section_id) AS n FROM t GROUP BY doc) """


@query(_TF + "SELECT tf.doc, tf.section_id, tf.term, tf, df, round(tf * ln(CAST(n AS DOUBLE) / (1 + df)), 6) AS weight FROM tf JOIN df USING (doc, term) JOIN n ON n.doc = tf.doc")
def tfidf_sections(spark, d):
    return A.tfidf(P.corpus(spark, d)).withColumn("weight", F.round("weight", 6))


@query(_TF + """, dt AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL), sp AS (SELECT term FROM dt GROUP BY term HAVING count(*) < (SELECT count(DISTINCT doc) FROM records)),
k AS (SELECT doc, term, tf, row_number() OVER (PARTITION BY doc ORDER BY tf DESC, term) AS rank FROM dt JOIN sp USING (term)) SELECT doc, term, tf, rank FROM k WHERE rank <= 25""")
def doc_terms_distinct(spark, d):
    return A.distinct_terms(P.corpus(spark, d))


_BREADTH = ["tion", "heit", "mente", "ed er", "zzz"]


@query(f"WITH {P.SQL_DOCS}, w(word) AS (VALUES {', '.join(f"('{w}')" for w in _BREADTH)}) SELECT word, count(*) FILTER (WHERE contains(norm, word)) AS hits, round(count(*) FILTER (WHERE contains(norm, word)) / count(*), 9) AS share FROM records, w WHERE label <> 'section_header' GROUP BY word")
def attribute_breadth(spark, d):
    return A.breadth(P.corpus(spark, d), _BREADTH).withColumn("share", F.round("share", 9))


@query(f"""WITH {P.SQL_DOCS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq) AS pos FROM records) SELECT id, 'D' || (seq // 1000000) || ':p1:§1' AS header_id, pos - 1 AS distance FROM p""")
def header_distance(spark, d):
    return A.last_header(P.rec_docs(spark, d, False)).select("id", "header_id", F.col("distance").cast("long").alias("distance"))


_SHARES = [0.5, 0.75, 0.9, 0.99, 1.0]


@query(f"""WITH {P.SQL_DOCS}, v AS (SELECT seq % 1000000 AS v FROM records), k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM v), n AS (SELECT count(*) AS n FROM v),
q(share) AS (VALUES {', '.join(f'({s})' for s in _SHARES)}) SELECT CAST(share AS DOUBLE) AS share, v AS value FROM q, n JOIN k ON place = CAST(round_even((n - 1) * share, 0) AS BIGINT)""")
def header_distance_pct(spark, d):
    h = A.last_header(P.rec_docs(spark, d, False)).withColumn("distance", F.col("distance").cast("long"))
    return A.nearest_rank(h, "distance", _SHARES)


@query(f"""WITH {P.SQL_DOCS}, s AS (SELECT doc, CASE WHEN label = 'section_header' OR parent_id = '' THEN id ELSE parent_id END AS section, row_number() OVER (PARTITION BY doc ORDER BY seq) AS pos FROM records),
g AS (SELECT count(*) OVER (PARTITION BY doc, section ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS mine, count(*) OVER (PARTITION BY doc, section) AS whole, count(*) OVER (PARTITION BY doc ORDER BY pos RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM s)
SELECT round(avg(CAST(mine AS DOUBLE) / whole), 9) AS recall, round(CAST(sum(near - mine) AS DOUBLE) / sum(near), 9) AS foreign_share FROM g""")
def window_recall(spark, d):
    return A.window_recall(P.rec_docs(spark, d, False), 10).select(F.round("recall", 9).alias("recall"), F.round("foreign", 9).alias("foreign_share"))


@query(f"WITH {P.SQL_DOCS} SELECT doc, count(*) FILTER (WHERE label = 'section_header') AS section_header, count(*) FILTER (WHERE label = 'text') AS text FROM records GROUP BY doc")
def label_pivot(spark, d):
    return A.labels_by_doc(P.rec_docs(spark, d, False), ["section_header", "text"])


_KEYS = {"cite": "cite", "doc+cite": "doc, cite", "doc+page+cite": "doc, page, cite"}


@query(f"WITH {P.SQL_DOCS}, " + ", ".join(f"k{i} AS (SELECT count(*) AS n FROM records WHERE cite <> '' GROUP BY {k})" for i, k in enumerate(_KEYS.values())) + " " + " UNION ALL ".join(f"SELECT '{n}' AS keying, count(*) AS keys, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS ambiguous, max(n) AS worst FROM k{i}" for i, n in enumerate(_KEYS)))
def cite_ambiguity(spark, d):
    return A.cite_ambiguity(P.rec_docs(spark, d, False))


@query("SELECT doc_id % 3 AS set, doc_id AS number, text AS question, NULLIF(quality, -1) AS answer, CASE WHEN text IS NULL THEN 'no question' WHEN quality IS NULL THEN 'no answer' ELSE '' END AS fault FROM documents FULL JOIN labels USING (doc_id)")
def gold_join(spark, d):
    q = P.read(spark, d, "documents").select((F.col("doc_id") % 3).alias("set"), F.col("doc_id").alias("number"), F.col("text").alias("question"))
    a = P.read(spark, d, "labels").select((F.col("doc_id") % 3).alias("set"), F.col("doc_id").alias("number"), F.col("quality").alias("answer"))
    return A.gold(q, a)


@query("SELECT doc_id, coalesce(n.quality, o.quality) AS quality, CASE WHEN n.quality IS NULL THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM (SELECT * FROM labels WHERE doc_id % 2 = 0) o FULL JOIN (SELECT * FROM labels WHERE doc_id % 3 = 0) n USING (doc_id)")
def gold_sync(spark, d):
    x = P.read(spark, d, "labels").select("doc_id", "quality")
    return A.sync(x.filter("doc_id % 2 = 0"), x.filter("doc_id % 3 = 0"), ["doc_id"], "quality")


@query("SELECT doc_id % 4 AS set, count(*) AS attempted, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS passes, round(count(*) FILTER (WHERE quality = 1) / count(*), 9) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id % 4")
def pass_rate(spark, d):
    key = ((F.col("doc_id") % 4).alias("set"), F.col("doc_id").alias("number"))
    return A.pass_rate(P.read(spark, d, "documents").select(*key), P.read(spark, d, "labels").select(*key, (F.col("quality") == 1).alias("passed"))).withColumn("rate", F.round("rate", 9))


@query("SELECT CASE WHEN grouping(probe) = 1 THEN 'all' ELSE probe END AS probe, count(*) AS truth, count(*) FILTER (WHERE ref % 2 = 0) AS found, round(count(*) FILTER (WHERE ref % 2 = 0) / count(*), 9) AS recall FROM (SELECT source AS probe, doc_id AS ref FROM documents) GROUP BY ROLLUP (probe)")
def routing_recall(spark, d):
    t = P.read(spark, d, "documents").select(F.col("source").alias("probe"), F.col("doc_id").alias("ref"))
    return A.routing_recall(t, t.filter("ref % 2 = 0")).select(F.coalesce("probe", F.lit("all")).alias("probe"), "truth", "found", F.round("recall", 9).alias("recall"))


@query("SELECT k, string_agg(line, ' ¶ ' ORDER BY r) AS text FROM (SELECT k, r, string_agg(t, ' | ' ORDER BY c) AS line FROM (SELECT g.k, g.r, g.c, coalesce(CAST(x.q AS VARCHAR), '') AS t FROM (SELECT k, unnest(range(mr + 1)) AS r, c FROM (SELECT k, mr, unnest(range(mc + 1)) AS c FROM (SELECT l_orderkey AS k, max(l_linenumber) AS mr, max(l_suppkey % 4) AS mc FROM lineitem GROUP BY 1))) g LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS r, l_suppkey % 4 AS c, max(l_partkey) AS q FROM lineitem GROUP BY ALL) x ON x.k = g.k AND x.r = g.r AND x.c = g.c) GROUP BY k, r) GROUP BY k")
def serialize_table(spark, d):
    c = P.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("row"), (F.col("l_suppkey") % 4).cast("int").alias("col"), F.col("l_partkey").cast("string").alias("text"), F.col("l_partkey").alias("pos"))
    return A.table_text(c, "k")


@query(f"WITH {P.SQL_DOCS} SELECT doc, CAST(sum(len(regexp_extract_all(norm, '(^|[^\\p{{L}}\\p{{N}}_])the [a-z]'))) AS BIGINT) AS pointers, count(*) FILTER (WHERE regexp_matches(norm, '(^|[^\\p{{L}}\\p{{N}}_])the [a-z]')) AS records FROM records GROUP BY doc")
def pointer_counts(spark, d):
    return A.pointers(P.corpus(spark, d), r"(?U)\bthe [a-z]").select("doc", F.col("pointers").cast("long").alias("pointers"), "records")


@query(f"WITH {P.SQL_DOCS} SELECT seq, id, parent_id, text FROM (SELECT 'C' || conv_id || ':p1:§' || turn AS id, conv_id * 100000 + turn AS seq, CASE WHEN turn = 0 THEN '' ELSE 'C' || conv_id || ':p1:§0' END AS parent_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}]+', ' ', 'g')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)")
def conversation_records(spark, d):
    return P.rec_conv(spark, d).select("seq", "id", "parent_id", "text")
