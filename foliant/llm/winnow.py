"""Benchmark decontamination by winnowing.

Every text is a sequence of words. Its K-word grams are hashed, and of each SPAN consecutive grams the
least hash is kept with its place (equal least hashes all). Two texts that share K + SPAN - 1 = WINDOW words
share such a fingerprint, at the same place of the shared words. Training fingerprints are joined with
the distinct benchmark fingerprints (a semi-join in effect: one row a fingerprint on the benchmark's side, so
nothing multiplies), and each hit is extended: the WINDOW-word windows around it are compared,
as whole strings, with the windows of the benchmark. Items shorter than WINDOW words are one window of
their own length; their windows are found by hash and compared as strings too.

Benchmark windows that occur in the same set of items are one class, so a passage that many items
share meets a document once and not once for each item and window.

DataFrame functions only. Arrays are opened with explode_outer: for the inner form the optimizer infers a filter
and computes the whole array a second time in it. Hashes are broadcast only where counting proves them `SMALL`.

Edge cases: null and empty texts have no words and aren't hit; a row is judged by its own text, whatever other rows share its id;
items of equal id count as one item, items without an id hit words but aren't named among the items; repeated rows give repeated
rows; empty tables give empty results or clean documents; other columns pass through (`screen`), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, named, stored

K, SPAN = 5, 6
WINDOW = K + SPAN - 1
#: Hashes (8 bytes each) that may be broadcast.
SMALL = 400_000
#: What parts words: ASCII but digits and lower-case letters (texts are lower-cased first).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_P = "__w_"


def item_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def with_fingerprints(df: DataFrame, text: str) -> DataFrame:
    """Adds the words, the hashes of all K-word grams, and fp: the places (from 0) of the fingerprints among them.

    A gram is least in one of the stretches it stands in if and only if it equals the greatest of
    their minima. Texts of fewer than WINDOW words have no fingerprints.
    """
    w, wh, h, m = (F.col(_P + x) for x in ("w", "wh", "h", "m"))
    some = F.size(w) >= WINDOW
    none = F.array().cast("array<bigint>")
    df = df.withColumn(_P + "w", item_words(F.col(text)))
    df = df.withColumn(_P + "wh", F.when(some, F.transform(w, lambda x: F.xxhash64(x))).otherwise(none))
    grams = F.transform(F.slice(wh, 1, F.size(wh) - (K - 1)), lambda x, i: F.xxhash64(x, *(F.get(wh, i + k) for k in range(1, K))))
    df = df.withColumn(_P + "h", F.when(some, grams).otherwise(none))
    stretches = F.transform(F.slice(h, 1, F.size(h) - (SPAN - 1)), lambda x, i: F.least(x, *(F.get(h, i + k) for k in range(1, SPAN))))
    df = df.withColumn(_P + "m", F.when(some, stretches).otherwise(none))
    at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.greatest(*(F.get(m, i - k) for k in range(SPAN))) == F.get(h, i))
    return df.withColumn(_P + "fp", F.when(some, at)).drop(_P + "wh", _P + "m")


def _grams(w: Column, n: Column) -> Column:
    """Every n-word window with its place."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, n), " ").alias("win")))


def is_small(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL


def windows_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, win): every WINDOW-word window of an item, or the whole of a shorter one."""
    w = F.col(_P + "w")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.array_join(F.slice(w, i, WINDOW), " "))
    one = F.when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    rows = benchmark.select(F.col(item).alias("item"), item_words(F.col(text)).alias(_P + "w"))
    return rows.select("item", F.least(F.size(w), F.lit(WINDOW)).alias("len"), F.explode_outer(F.when(F.size(w) >= WINDOW, many).otherwise(one)).alias("win")).filter("win IS NOT NULL").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(same, at, len, win) for every place where a benchmark window stands in a text (same: the text's hash), and (item, len, win)."""
    wins = windows_of(benchmark, item, text)
    keys = wins.select("win", "len").distinct()
    marks = with_fingerprints(benchmark.select(text), text).select(_P + "h", F.explode_outer(_P + "fp").alias("f")).filter("f IS NOT NULL").select(F.get(_P + "h", "f").alias("mark")).distinct()
    rows = docs.select(same_text(named(docs, text)).alias("same"), named(docs, text).alias("text"))
    w, f = F.col(_P + "w"), F.col("f")
    # the words from which every window over a fingerprint can be cut
    first = F.greatest(f - (SPAN - 1), F.lit(0))
    around = (first.alias("from"), F.slice(w, first + 1, f + WINDOW - first).alias("near"))
    found = with_fingerprints(rows, "text").select("same", _P + "w", _P + "h", F.explode_outer(_P + "fp").alias("f")).filter("f IS NOT NULL")
    mark = F.get(F.col(_P + "h"), f)
    if is_small(marks):
        found = found.join(F.broadcast(marks), mark == F.col("mark")).select("same", *around)
    else:  # what is shuffled then holds a few words for each fingerprint, not whole texts
        found = found.select("same", mark.alias("mark"), *around).join(marks, "mark").select("same", "from", "near")
    near = F.col("near")
    cut = F.transform(F.sequence(F.lit(0), F.size(near) - WINDOW), lambda i: F.struct((F.col("from") + i).alias("at"), F.array_join(F.slice(near, i + 1, WINDOW), " ").alias("win")))
    long = found.filter(F.size(near) >= WINDOW).select("same", F.explode_outer(cut).alias("c")).select("same", F.col("c.at").alias("at"), F.lit(WINDOW).alias("len"), F.col("c.win").alias("win")).distinct()
    short = [r[0] for r in wins.filter(F.col("len") < WINDOW).select("len").distinct().collect()]  # WINDOW - 1 lengths at most
    if short:  # one more pass, whatever their number
        heads = keys.filter(F.col("len") < WINDOW).select(F.xxhash64("win", "len").alias("mark")).distinct()
        more = rows.select("same", item_words(F.col("text")).alias(_P + "w")).select("same", _P + "w", F.explode(F.array(*(F.lit(n) for n in sorted(short)))).alias("n"))
        more = more.select("same", "n", F.explode_outer(F.when(F.size(w) >= F.col("n"), _grams(w, F.col("n")))).alias("c")).filter("c IS NOT NULL")
        more = more.join(F.broadcast(heads) if is_small(heads) else heads, F.xxhash64("c.win", "n") == F.col("mark"), "left_semi")
        long = long.unionByName(more.select("same", F.col("c.at").alias("at"), F.col("n").alias("len"), F.col("c.win").alias("win")).distinct())
    return long.join(keys.select("win", "len"), ["win", "len"], "left_semi").select("same", "at", "len", "win"), wins


def same_text(text: Column) -> Column:
    """What stands for a document here: a hash of its text, so that rows are judged by what they hold and copies only once."""
    return F.xxhash64(text)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """Of every text that holds a benchmark window: same (`same_text` of it), n_hit (words inside one) and items (array, as found)."""
    found, wins = hits(docs, benchmark, text, item)
    found = stored(found, "hits")
    # hit words: the union of the intervals, in order of their starts
    spans = F.array_sort(F.collect_set(F.struct("at", F.col("len").alias("len"))))
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["end"], s["at"]))).alias("n")),
        lambda a: a["n"],
    )
    counts = found.groupBy("same").agg(spans.alias("spans")).select("same", union.cast("long").alias("n_hit"))
    # windows of the same set of items are one class; the class is told by order-free digests of the set
    i = F.col("item").cast("string")
    classes = wins.groupBy("win", "len").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64(i)).alias("x"), F.bit_xor(F.xxhash64(i, F.lit(1))).alias("y"), F.min(i).alias("z"))
    heads = classes.groupBy("c", "x", "y", "z").agg(F.min(F.struct("win", "len")).alias("head"))
    of_class = classes.join(heads, [classes[c].eqNullSafe(heads[c]) for c in ("c", "x", "y", "z")]).select("win", "len", "head")
    members = heads.select("head", F.col("head.win").alias("win"), F.col("head.len").alias("len")).join(wins, ["win", "len"]).select("head", "item")
    met = found.select("same", "win", "len").distinct().join(of_class, ["win", "len"]).select("same", "head").distinct()
    items = met.join(members, "head").groupBy("same").agg(F.collect_set("item").alias("items"))
    # stored, so that a join of documents with it is a join of two plain tables: rows of a hot text can be split then
    return stored(counts.join(items, "same", "left").select("same", "n_hit", F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items")), "contaminated")


def screen(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    bad = contamination(docs, benchmark, text, item).select(F.col("same").alias(_P + "same"))
    return docs.join(F.broadcast(bad) if is_small(bad) else bad, same_text(named(docs, text)) == F.col(_P + "same"), "left_anti")
