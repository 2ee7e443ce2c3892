"""Gates over records and provenance: each check returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from .geometry import covering
from .search import _links, ancestry, jumps


def duplicate_ids(r: DataFrame) -> DataFrame:
    return r.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def missing_parents(r: DataFrame) -> DataFrame:
    return r.filter("parent_id <> ''").join(r.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def _with_parent(r: DataFrame) -> DataFrame:
    return r.alias("c").join(r.alias("p"), F.col("c.parent_id") == F.col("p.id"))


def foreign_parents(r: DataFrame) -> DataFrame:
    return _with_parent(r).filter("c.doc <> p.doc").select("c.id", "c.parent_id")


def late_parents(r: DataFrame) -> DataFrame:
    return _with_parent(r).filter("p.seq >= c.seq").select("c.id", "c.parent_id")


def later_page_parents(r: DataFrame) -> DataFrame:
    return _with_parent(r).filter("p.page > c.page").select("c.id", "c.parent_id")


def cycles(r: DataFrame, depth: int | None = None) -> DataFrame:
    """Records that are their own ancestors, within so many levels or at any distance.

    Doubling jumps come to an end but for records that lead into a cycle; where jumps longer than there are records arrive is on one, and so all of a cycle is reached.
    """
    if depth is not None:
        return ancestry(r, depth).filter("id = ancestor_id").select("id").distinct()
    steps, endless = jumps(_links(r))
    return r.select("id").limit(0) if endless is None else steps[-1].select(F.col("up").alias("id")).distinct()


def wrong_norms(r: DataFrame) -> DataFrame:
    """Records whose norm isn't that of their text; a missing one isn't either."""
    return r.filter(~F.col("norm").eqNullSafe(normalize(F.col("text")))).select("id")


def picture_texts(r: DataFrame) -> DataFrame:
    """A text is empty if and only if the record is a picture: whatever breaks that, either way. A missing text is an empty one."""
    empty, picture = F.coalesce("text", F.lit("")) == "", F.coalesce(F.col("label") == "picture", F.lit(False))
    return r.filter(empty != picture).select("id", "label")


def odd_ids(r: DataFrame) -> DataFrame:
    return r.filter(~F.expr("startswith(id, concat(doc, ':p', page, ':'))")).select("id")


def with_source(r: DataFrame, prov: DataFrame) -> DataFrame:
    """Records with the ranges that hold their page: one in sound data, none or several otherwise."""
    rows = r.select("id", "doc", "page", "label")
    held = covering(rows.select("doc", "page").distinct(), prov.select("doc", "page_from", "page_to", "source"), ["doc"], "page", "page_from", "page_to")
    return rows.join(held.select("doc", "page", "source"), ["doc", "page"], "left").select("id", "doc", "page", "label", "source")


def uncovered_pages(r: DataFrame, prov: DataFrame) -> DataFrame:
    return with_source(r, prov).groupBy("id").agg(F.count("source").alias("n")).filter("n <> 1")


def broken_ranges(prov: DataFrame) -> DataFrame:
    """Ranges that don't follow on the one before, or don't begin at page 1."""
    before = F.lag("page_to").over(Window.partitionBy("doc").orderBy("page_from", "page_to"))
    return prov.withColumn("before", F.coalesce(before, F.lit(0))).filter("page_from <> before + 1 OR page_to < page_from").select("doc", "page_from", "page_to")


def roster(r: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, what): documents that are missing or not wanted."""
    have, want = r.select("doc").distinct(), wanted.select("doc").distinct()
    return want.exceptAll(have).withColumn("what", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("what", F.lit("unexpected")))


def caveats(r: DataFrame, prov: DataFrame) -> DataFrame:
    """Each record and whether it is a table read by OCR, which a citation must disclose."""
    return with_source(r, prov).select("id", F.coalesce((F.col("label") == "table") & (F.col("source") == "ocr"), F.lit(False)).alias("caveat"))


def bands(r: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, label, n, ok) against the least counts in wanted (doc, label, least)."""
    n = r.groupBy("doc", "label").agg(F.count("*").alias("n"))
    return wanted.join(n, ["doc", "label"], "left").select("doc", "label", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("ok"))


def fingerprint(r: DataFrame) -> DataFrame:
    """One row that two equal rebuilds share: order is part of the rows, so an order-free sum of their hashes does."""
    h = F.xxhash64(*r.columns)
    return r.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s"))


GATES = {"duplicate_ids": duplicate_ids, "missing_parents": missing_parents, "foreign_parents": foreign_parents, "late_parents": late_parents, "later_page_parents": later_page_parents, "cycles": cycles, "wrong_norms": wrong_norms, "picture_texts": picture_texts, "odd_ids": odd_ids}


def failures(r: DataFrame, prov: DataFrame | None = None) -> DataFrame:
    """(gate, n) of every gate that fails."""
    parts = [f(r).agg(F.count("*").alias("n")).select(F.lit(k).alias("gate"), "n") for k, f in GATES.items()]
    if prov is not None:
        parts += [uncovered_pages(r, prov).agg(F.count("*").alias("n")).select(F.lit("uncovered_pages").alias("gate"), "n"), broken_ranges(prov).agg(F.count("*").alias("n")).select(F.lit("broken_ranges").alias("gate"), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")
