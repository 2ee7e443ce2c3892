"""Quality rules: base rules on a text, then a hashed n-gram log-likelihood ratio.

Each document is a bag of unigrams and bigrams of its tokens (runs of letters and digits, and runs of other
characters but white space), hashed into `BUCKETS` buckets. Two
multinomials are counted: the raw corpus (every document) and the trusted target (documents that
labels mark as of quality 1). The target is smoothed towards the raw one with `PRIOR` pseudo-counts,
so that buckets without evidence weigh nothing. A document's score is the mean over its features of
log(target / raw); it is kept where the score is `LEAST` or more. Nothing is drawn at random.

DataFrame functions only. The weights (a fixed number of buckets, whatever the input) come to the
driver and go back as one constant; the trusted rows behind the target are the `TRUSTED` labelled
ones with the smallest hash of their id, at most, which bounds what is broadcast. The raw counts
cover all documents.

Edge cases: a null or empty text has no words, fails the base rule and isn't kept; a null doc_id is
never trusted; without trusted rows every weight is 0 and the base rules decide; repeated rows give
repeated rows; an empty table gives an empty table. Other columns pass through, but
for those with names of the result's own columns, which are replaced, and for names that begin with `__q_`, which are taken; callers with any names put them in a struct first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

BUCKETS, PRIOR, LEAST, TRUSTED = 1 << 14, 4000.0, -0.3, 30_000
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "[#*$%&|<>]"
TOKENS = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"
_P = "__q_"


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and the words in a column of this module.

    n_repeat_words counts the words inside 5-word windows that are found twice or more, the first one
    included. Windows are compared by 64-bit hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w, win, srt, pos = (F.col(_P + x) for x in ("words", "windows", "sorted", "starts"))
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    df = df.withColumn(_P + "words", words(F.col(text))).withColumn(_P + "hashes", hashed)
    h = F.col(_P + "hashes")
    df = df.withColumn(_P + "windows", F.when(F.size(w) >= WINDOW, F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: only the others are sorted
    df = df.withColumn(_P + "sorted", F.when(F.size(F.array_distinct(win)) < F.size(win), F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter(srt, lambda x, i: F.coalesce(x["h"] == F.get(srt, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(srt, i + 1)["h"], F.lit(False)))
    df = df.withColumn(_P + "starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform(pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return (
        df.withColumn(_P + "lines", lines)
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(t, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size(_P + "lines") - F.size(F.array_distinct(_P + "lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT))
    )


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0)), lambda x: F.xxhash64(x))


def features(hashes: Column) -> Column:
    """Buckets of the unigrams and bigrams of an array of token hashes."""
    pairs = F.when(F.size(hashes) > 1, F.transform(F.slice(hashes, 1, F.size(hashes) - 1), lambda x, i: F.pmod(F.xxhash64(x, F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int")))
    return F.concat(F.transform(hashes, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")), F.coalesce(pairs, F.array().cast("array<int>")))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> list[float]:
    """The weight of every bucket: log of target over raw."""
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)
    trusted = F.broadcast(trusted.select(F.col("doc_id").alias(_P + "id"), F.lit(1).alias(_P + "hit")))
    rows = docs.select("doc_id", token_hashes(F.col(text)).alias("h")).join(trusted, F.col("doc_id") == F.col(_P + "id"), "left")
    counts = rows.select(_P + "hit", F.explode_outer(features(F.col("h"))).alias("b")).filter("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("raw"), F.count(_P + "hit").alias("target")).orderBy("b")
    n = F.sum("raw").over(_all := _whole()), F.sum("target").over(_all)
    share = F.col("raw") / n[0]
    weight = F.log((F.col("target") + share * PRIOR) / (n[1] + F.lit(PRIOR)) / share)
    out = [0.0] * BUCKETS
    for b, x in counts.select("b", weight.alias("w")).collect():  # one row for each bucket
        out[b] = x
    return out


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def assess(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, base_failed, score (mean log-likelihood ratio; null without words) and kept."""
    weights = fit(docs, labels, text)
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    f = F.col(_P + "features")
    df = base_counts(docs, text).withColumn(_P + "tokens", token_hashes(F.col(text))).withColumn(_P + "features", features(F.col(_P + "tokens")))
    total = F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(table, b))
    df = df.withColumn("score", F.try_divide(total, F.size(f)))
    # a filter on a result must not be pushed down: it would take all the expressions above along, nested in one
    # another. An expression that the optimizer takes for indeterminate stops it; it is always true
    here = F.monotonically_increasing_id() >= 0
    df = df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= LEAST, F.lit(False)) & here)
    return df.drop(*(c for c in df.columns if c.startswith(_P)))
