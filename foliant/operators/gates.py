"""Gates over what a corpus says: symbols and angles that must be there, values and furniture that must not, chains that were verified by hand.

What is expected is data: tables that the caller gives, never constants of the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import ancestry

ANGLE = r"[±<>≥≤]?(?U:\s)*[0-9]+(?U:\s)*[º°]"


def band(name: Column | str, n: Column, least: Column) -> list[Column]:
    return [(F.lit(name) if isinstance(name, str) else name).alias("what"), n.alias("n"), (n >= least).alias("ok")]


def symbol_bands(r: DataFrame, wanted: DataFrame) -> DataFrame:
    """(what, n, ok) for wanted (what, least): how often each string stands in the texts, against the least count."""
    # every row of the small table of wanted strings meets every text once, in one pass over the texts
    names = [row["what"] for row in wanted.select("what").distinct().collect()]
    counts = r.agg(*(F.coalesce(F.sum(F.regexp_count("text", F.lit(_literal(s)))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(names)), F.lit(0).alias("none"))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(s).alias("what"), F.col(f"n{i}").alias("n")) for i, s in enumerate(names)))).alias("x")).select("x.*") if names else counts.select(F.lit("").alias("what"), F.lit(0).cast("long").alias("n")).filter("false")
    return wanted.join(long, "what").select(*band(F.col("what"), F.col("n"), F.col("least")))


def _literal(s: str) -> str:
    return "".join("\\" + c if ord(c) < 128 and not c.isalnum() else c for c in s)


def angles(r: DataFrame) -> DataFrame:
    """(angle, n): every angle that the texts name, without white space and comparison."""
    found = r.select(F.explode_outer(F.regexp_extract_all("text", F.lit(ANGLE), F.lit(0))).alias("a")).filter("a IS NOT NULL")
    bare = F.regexp_replace(F.regexp_replace("a", r"(?U)\s", ""), "^[±<>≥≤]", "")
    return found.groupBy(bare.alias("angle")).agg(F.count("*").alias("n"))


def angle_bands(r: DataFrame, wanted: DataFrame) -> DataFrame:
    """(what, n, ok) for wanted (what, least)."""
    found = wanted.join(angles(r).withColumnRenamed("angle", "what"), "what", "left")
    n = F.coalesce("n", F.lit(0))
    return found.select(*band(F.col("what"), n, F.col("least")))


def phantoms(r: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(what, n, ok): values that were never in the source, by pattern (?U is set); none may be found."""
    counts = r.agg(*(F.coalesce(F.sum(F.regexp_count("text", F.lit("(?U)" + p))), F.lit(0)).alias(f"n{i}") for i, p in enumerate(patterns.values())))
    return _none(counts, list(patterns))


def furniture(r: DataFrame, strings: list[str]) -> DataFrame:
    """(what, n, ok): records that hold a piece of page furniture; none may."""
    return _none(r.agg(*(F.coalesce(F.sum(F.col("text").contains(s).cast("long")), F.lit(0)).alias(f"n{i}") for i, s in enumerate(strings))), strings)


def _none(counts: DataFrame, names: list[str]) -> DataFrame:
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(s).alias("what"), F.col(f"n{i}").alias("n")) for i, s in enumerate(names)))).alias("x"))
    return long.select("x.what", "x.n", (F.col("x.n") == 0).alias("ok"))


def printed_pages(r: DataFrame) -> DataFrame:
    """(doc, page, printed): the page numbers that the source prints, read from records that are nothing else."""
    number = F.regexp_extract("text", r"^Pág\.(?U:\s)*([0-9]+)$", 1)
    return r.filter(number != "").groupBy("doc", "page").agg(F.min(number.cast("long")).alias("printed"))


def foreign_sources(prov: DataFrame) -> DataFrame:
    """Ranges that aren't native."""
    return prov.filter(~F.col("source").eqNullSafe(F.lit("native"))).select("doc", "page_from", "page_to", "source")


def chains(r: DataFrame, having: str, want: list[str], chain: DataFrame | None = None) -> DataFrame:
    """(id, chain, ok) of every record whose text has a string: its nearest ancestors by cite (or text) must be these, nearest first."""
    mine = r.filter(F.col("text").contains(having)).select("id")
    above = chain if chain is not None else ancestry(r, ids=mine)
    name = F.when(F.col("cite") != "", F.col("cite")).otherwise(F.substring("text", 1, 24))
    rows = mine.join(above, "id").join(r.select(F.col("id").alias("ancestor_id"), name.alias("name")), "ancestor_id")
    got = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "name"))), lambda x: x["name"]).alias("chain"))
    out = mine.join(got, "id", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>")))
    return out.select("id", "chain", (F.slice("chain", 1, len(want)) == F.array(*map(F.lit, want))).alias("ok"))


def failures(*gates: DataFrame) -> DataFrame:
    """What fails of gates with (what, ok)."""
    out = None
    for g in gates:
        one = g.filter("NOT ok").select("what")
        out = one if out is None else out.unionByName(one)
    return out
