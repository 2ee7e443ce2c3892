"""Measurements over records: term weights, recall of windows, ambiguity of cites, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .order import preceding

WORD = r"[a-záéíóúüñ]{5,}"
#: Frequent words of legal texts that tell no section from another, and how many terms an index line has.
STOP_WORDS = (
    "acuerdo", "casos", "condiciones", "considera", "correspondiente", "correspondientes", "cualquier", "cuando", "debera", "deberan", "deben", "desde", "dicha", "dicho", "entre", "establece",
    "establecido", "forma", "hasta", "menos", "misma", "mismo", "otras", "otros", "partes", "puede", "pueden", "segun", "siempre", "sobre", "todas", "todos",
)
INDEX_TERMS = 8


def terms(r: DataFrame, column: str = "norm") -> DataFrame:
    """(doc, section_id, seq, k, term): words of five letters and more, with their place."""
    section = F.when(F.col("parent_id") == "", F.col("id")).otherwise(F.col("parent_id"))
    return r.select("doc", section.alias("section_id"), "seq", F.posexplode_outer(F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0))).alias("k", "term")).filter("term IS NOT NULL")


def tfidf(r: DataFrame, stop: list[str] = [], top: int | None = None, column: str = "norm") -> DataFrame:  # noqa: B006
    """tf * ln(N / (1 + df)) of each term of a section; N and df are those of its document.

    The words of a record are dealt by document once, as one text; all counts are taken from there without another shuffle or a second branch.
    """
    section = F.when(F.col("parent_id") == "", F.col("id")).otherwise(F.col("parent_id"))
    words = r.select("doc", section.alias("section_id"), "seq", F.array_join(F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(0)), " ").alias("words")).repartition("doc")
    t = words.select("doc", "section_id", "seq", F.posexplode_outer(F.split("words", " ")).alias("k", "term")).filter("term <> ''")
    t = t.filter(~F.col("term").isin(stop)) if stop else t
    tf = t.groupBy("doc", "section_id", "term").agg(F.count("*").alias("tf"), F.min(F.struct("seq", "k")).alias("at"))
    tf = tf.withColumn("df", F.count("*").over(Window.partitionBy("doc", "term")))
    first = (F.row_number().over(Window.partitionBy("doc", "section_id").orderBy("term")) == 1).cast("long")
    out = tf.withColumn("first", first).withColumn("n", F.sum("first").over(Window.partitionBy("doc"))).withColumn("weight", F.col("tf") * F.log(F.col("n") / (1 + F.col("df"))))
    if top is not None:
        w = Window.partitionBy("section_id").orderBy(F.desc("weight"), "at")
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
        return out.select("doc", "section_id", "term", "tf", "df", "weight", "rank")
    return out.select("doc", "section_id", "term", "tf", "df", "weight")


def index_terms(r: DataFrame, top: int = INDEX_TERMS, column: str = "text") -> DataFrame:
    """The terms of an index line of each section, by weight and then by first occurrence."""
    return tfidf(r, stop=list(STOP_WORDS), top=top, column=column)


def distinct_terms(r: DataFrame, top: int = 25) -> DataFrame:
    """The most frequent terms of each document, without those that every document has."""
    tf = terms(r).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    docs = r.agg(F.count_distinct("doc").alias("docs"))
    spread = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(docs)).filter("df < docs").select("term", "df")
    w = Window.partitionBy("doc").orderBy(F.desc("tf"), "term")
    return tf.join(spread, "term").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("doc", "term", "tf", "rank")


def breadth(r: DataFrame, words: list[str]) -> DataFrame:
    """For each word, how many records contain it, and the share."""
    body = r.filter("label <> 'section_header'")
    counts = body.agg(F.count("*").alias("n"), *(F.sum(F.col("norm").contains(w).cast("long")).alias(f"c{i}") for i, w in enumerate(words)))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.coalesce(f"c{i}", F.lit(0)).alias("hits")) for i, w in enumerate(words)))).alias("x")).select("x.word", "x.hits", F.try_divide("x.hits", "n").alias("share"))


def last_header(r: DataFrame) -> DataFrame:
    """Each record with the nearest header before it in its document, and the distance in records."""
    w = Window.partitionBy("doc").orderBy("seq")
    pos = r.withColumn("pos", F.row_number().over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    header = F.last(F.when(F.col("label") == "section_header", F.struct("id", "pos")), ignorenulls=True).over(upto)
    return pos.withColumn("h", header).select("doc", "seq", "id", "pos", F.col("h.id").alias("header_id"), (F.col("pos") - F.col("h.pos")).alias("distance"))


def nearest_rank(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at rank round((n - 1) * share), half to even; nulls come first.

    Ranks come from counts of values, added up over ranges of values: no task holds them all.
    """
    counts = stored(values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c")), "values")
    some = counts.filter("v IS NOT NULL")
    none = counts.filter("v IS NULL").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("nulls"))
    upto = preceding(some, "v", "c").join(some, "v").join(F.broadcast(none)).select("v", (F.col("upto") + F.col("nulls")).alias("to"), "c")
    upto = upto.withColumn("from", F.col("to") - F.col("c"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    want = total.select(F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.bround((F.col("n") - 1) * s).cast("long").alias("at")) for s in shares))).alias("q")).select("q.*")
    return want.join(upto, (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")), "left").select("share", F.coalesce("v", F.lit(0)).alias("value"))


def window_recall(r: DataFrame, n: int) -> DataFrame:
    """Of each record's section, the share of members within n records; and the share of the window that is foreign."""
    w = Window.partitionBy("doc").orderBy("seq")
    section = F.when((F.col("label") == "section_header") | (F.col("parent_id") == ""), F.col("id")).otherwise(F.col("parent_id"))
    rows = r.withColumn("section", section).withColumn("pos", F.row_number().over(w)).select("doc", "section", "pos")
    near = Window.partitionBy("doc").orderBy("pos").rangeBetween(-n, n)
    mine = Window.partitionBy("doc", "section").orderBy("pos").rangeBetween(-n, n)
    whole = Window.partitionBy("doc", "section")
    got = rows.select(F.count("*").over(mine).alias("mine"), F.count("*").over(whole).alias("whole"), F.count("*").over(near).alias("near"))
    return got.agg(F.avg(F.col("mine") / F.col("whole")).alias("recall"), (F.sum(F.col("near") - F.col("mine")) / F.sum("near")).alias("foreign"))


def labels_by_doc(r: DataFrame, names: list[str]) -> DataFrame:
    return r.groupBy("doc").pivot("label", names).count().na.fill(0)


def cite_ambiguity(r: DataFrame) -> DataFrame:
    """For three keyings of cites: keys, ambiguous ones, the most records of one key."""
    c = r.filter("cite <> ''")
    sizes = c.groupingSets([["cite"], ["cite", "doc"], ["cite", "doc", "page"]], "cite", "doc", "page").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    name = F.when(F.col("g") == 3, "cite").when(F.col("g") == 1, "doc+cite").otherwise("doc+page+cite")
    return sizes.groupBy(name.alias("keying")).agg(F.count("*").alias("keys"), F.sum((F.col("n") > 1).cast("long")).alias("ambiguous"), F.max("n").alias("worst"))


def pointers(r: DataFrame, pointer: str) -> DataFrame:
    """Per document: places that match, and records with one. What the pointers lead to is told by evidence.pointers."""
    n = F.regexp_count(F.col("norm"), F.lit(pointer))
    return r.groupBy("doc").agg(F.sum(n).alias("pointers"), F.sum((n > 0).cast("long")).alias("records"))


def pass_rate(attempted: DataFrame, results: DataFrame) -> DataFrame:
    """Per set: attempts, passes and their share; an attempt without a result counts as failed."""
    rows = attempted.join(results, ["set", "number"], "left")
    return rows.groupBy("set").agg(F.count("*").alias("attempted"), F.sum(F.coalesce(F.col("passed"), F.lit(False)).cast("long")).alias("passes"), F.avg(F.coalesce(F.col("passed"), F.lit(False)).cast("double")).alias("rate"))


def sync(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Upsert with archive: key, value, status. Rows gone from new are archived, never deleted; rows that return are active."""
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    gone = F.col(f"n.{value}").isNull()
    return j.select(*key, F.coalesce(F.col(f"n.{value}"), F.col(f"o.{value}")).alias(value), F.when(gone, "ARCHIVED").otherwise("ACTIVE").alias("status"))


def active(items: DataFrame, of_set=None) -> DataFrame:
    """Items (set, status) that are still in the set, all or those of one set; archived ones are never run."""
    rows = items.filter("status = 'ACTIVE'")
    return rows if of_set is None else rows.filter(F.col("set") == of_set)


def gold(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers; which side a key lacks is told, for a mismatch is an error."""
    j = questions.alias("q").join(answers.alias("a"), ["set", "number"], "full_outer")
    return j.select("set", "number", "question", "answer", F.when(F.col("question").isNull(), "no question").when(F.col("answer").isNull(), "no answer").otherwise("").alias("fault"))


def routing_recall(truth: DataFrame, routed: DataFrame) -> DataFrame:
    """found / truth of each probe, and of all (probe null)."""
    hit = truth.join(routed.withColumn("hit", F.lit(1)).distinct(), ["probe", "ref"], "left")
    return hit.rollup("probe").agg(F.count("*").alias("truth"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


def gap_fill(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """OCR ranges of each document completed by native ones: before, between and after them, or the whole."""
    w = Window.partitionBy("doc").orderBy("page_from")
    before = ocr.select("doc", (F.coalesce(F.lag("page_to").over(w), F.lit(0)) + 1).alias("page_from"), (F.col("page_from") - 1).alias("page_to"))
    tail = pages.join(ocr.groupBy("doc").agg(F.max("page_to").alias("end")), "doc", "left").select("doc", (F.coalesce("end", F.lit(0)) + 1).alias("page_from"), F.col("n").alias("page_to"))
    native = before.unionByName(tail).filter("page_from <= page_to").withColumn("source", F.lit("native"))
    return ocr.select("doc", "page_from", "page_to", F.lit("ocr").alias("source")).unionByName(native)


def table_text(cells: DataFrame, key: str) -> DataFrame:
    """Cells (key, row, col, text) of grids of n_rows by n_cols as text: cells by ' | ', rows by ' ¶ '; the last of equal places wins."""
    last = cells.groupBy(key, "row", "col").agg(F.max_by("text", "pos").alias("text"))
    grid = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "text"))).alias("m"), F.max("row").alias("r"), F.max("col").alias("c"))

    def cell(i: Column, j: Column) -> Column:
        return F.coalesce(F.element_at("m", F.struct(i.alias("row"), j.alias("col"))), F.lit(""))

    rows = F.transform(F.sequence(F.lit(0), "r"), lambda i: F.array_join(F.transform(F.sequence(F.lit(0), "c"), lambda j: cell(i, j)), " | "))
    return grid.select(key, F.array_join(rows, " ¶ ").alias("text"))
