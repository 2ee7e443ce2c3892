"""The queries opN_* and their SQL: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, importance, kneser_ney, langid, pieces, quality, setjoin, sharding, toxicity, vector_codes, warc, webp, winnow
from .common import fold, stored, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.round_trip(docs, piece_model())
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.assess(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


@query
def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    bad = winnow.contamination(docs, bench)
    ids = F.array_sort(F.col("items").cast("array<string>"))
    bad = bad.select("same", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    counts = docs.select("doc_id", F.size(winnow.item_words(F.col("text"))).cast("long").alias("n_words"), winnow.same_text(F.col("text")).alias("same"))
    return counts.join(bad, "same", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.assess(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"), F.size("passages").alias("n_passages"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", F.col("full_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
"""


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back from the compacted store."""
    store = sharding.shard(table(spark, sf_dir, "documents"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


SQL["op4_sharding"] = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setjoin.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), kneser_ney.FOLDS) == kneser_ney.HELD_OUT, F.lit(False))
    model = kneser_ney.fit(docs.filter(~held), order=kneser_ney.ORDER)
    out = kneser_ney.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs)
    out = langid.identify(docs.select("doc_id", "text"), net)
    held = F.coalesce(fold(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = importance.weigh(docs, table(spark, sf_dir, "benchmark").select("text")).drop("text")
    return importance.draw(out).select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    out, books = vector_codes.compress(vectors)
    coded = stored(out.select("vec_id", "label", "coded.code", "coded.error"), "coded")
    by_label = vector_codes.label_errors(coded, "label", F.col("error"))
    code = F.array_join(F.transform("code", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0")), "")
    same = coded["label"].eqNullSafe(by_label["label"])
    return coded.join(by_label, same).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).alias("codebooks_sha256"))


@query
def op13_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are a table in the shared folder, read back before they are decoded."""
    media = stored(webp.to_media(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    back = webp.from_media(media)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -webp.ROW, webp.ROW)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

SQL["op10_winnow"] = f"""
WITH dw AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, s.item_id FROM places p JOIN wins s ON p.n = s.n AND p.win = s.win),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN found ON found.doc_id = dw.doc_id
"""

SQL["op6_setjoin"] = f"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""


def _codes_sql() -> str:
    """Lloyd's rounds written out, one after another. Doubles are exact here: distances of these vectors stay far below 2^53."""
    kept = """
WITH x AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM x, range(4) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 256)"""
    near = """,
near{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS n FROM (
  SELECT a.r, a.p, b.e, list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v) AS d FROM parts a JOIN book{i} b ON a.p = b.p) GROUP BY ALL)"""
    moved = """,
means{j} AS (SELECT p, e, list(m ORDER BY k) AS v FROM (SELECT a.p, n.n.e AS e, k, floor(sum(a.v[k]) / count(*)) AS m FROM parts a JOIN near{i} n ON a.r = n.r AND a.p = n.p, unnest(range(1, len(a.v) + 1)) u(k) GROUP BY ALL) GROUP BY ALL),
book{j} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN means{j} m ON b.p = m.p AND b.e = m.e)"""
    rounds = "".join(near.format(i=i) + moved.format(i=i, j=i + 1) for i in range(4)) + near.format(i=4)
    return kept + rounds + """,
done AS (SELECT x.vec_id, x.label, string_agg(lpad(lower(to_hex(n.n.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(n.n.d) AS BIGINT) AS error FROM x JOIN near4 n ON n.r = x.r GROUP BY x.r, x.vec_id, x.label),
sha AS (SELECT sha256(string_agg(CAST(CAST(v[k] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS s FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS k FROM book4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM sha) AS codebooks_sha256 FROM done
"""


SQL["op12_vector_codes"] = _codes_sql()
