"""Boxes on pages: containment, figures that are none, reading order, and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD, BAND, SLACK = 2.0, 4.0, 6.0


def edges(a: str) -> tuple[Column, Column]:
    return F.least(F.col(f"{a}.t"), F.col(f"{a}.b")), F.greatest(F.col(f"{a}.t"), F.col(f"{a}.b"))


def inside(a: str, b: str, pad: float = PAD) -> Column:
    """Alias a's box lies in alias b's, `pad` points of tolerance on each side."""
    (low, high), (under, over) = edges(a), edges(b)
    return (F.col(f"{a}.l") >= F.col(f"{b}.l") - pad) & (F.col(f"{a}.r") <= F.col(f"{b}.r") + pad) & (low >= under - pad) & (high <= over + pad)


#: Side of the smallest tiles, in points.
TILE = 16.0


def contained(inner: DataFrame, outer: DataFrame, on: list[str], pad: float = PAD) -> DataFrame:
    """(i, o) of boxes (on, i or o, l, r, t, b) that lie in another with the same `on`, `pad` points of tolerance on each side; i and o are keys.

    Pages are cut into tiles, in levels whose tiles double in side. An outer box goes to the tiles that it touches at the level of its own size, four at most or
    nine with the tolerance; an inner one to the tile of its corner, at each level in use. So a pair meets in one tile, and a crowded page is many small joins.
    Boxes whose left edge lies right of their right one meet by page alone.
    """
    low, high = F.least("t", "b"), F.greatest("t", "b")
    x, o = inner.select(*on, "i", "l", "r", low.alias("low"), high.alias("high")), outer.select(*on, "o", F.col("l").alias("ol"), F.col("r").alias("or"), low.alias("olow"), high.alias("ohigh"))
    test = (F.col("l") >= F.col("ol") - pad) & (F.col("r") <= F.col("or") + pad) & (F.col("low") >= F.col("olow") - pad) & (F.col("high") <= F.col("ohigh") + pad)
    side = F.greatest(F.col("or") - F.col("ol"), F.col("ohigh") - F.col("olow"), F.lit(0.0)) + 2 * pad
    level = F.greatest(F.ceil(F.log2(side / TILE)), F.lit(0)).cast("int")
    o = o.filter("ol IS NOT NULL AND `or` IS NOT NULL AND olow IS NOT NULL AND ohigh IS NOT NULL").withColumn("level", level)
    levels = sorted(r["level"] for r in o.select("level").distinct().collect())  # as many as doublings of a tile fit a page
    plain, odd = x.filter("l <= r"), x.filter("l > r")
    size = F.lit(TILE) * F.pow(F.lit(2.0), F.col("level"))
    tile = lambda c: F.floor(c / size)
    touched = lambda first, last: F.explode(F.sequence(tile(F.col(first) - pad), F.greatest(tile(F.col(first) - pad), tile(F.col(last) + pad))))
    dealt = o.withColumn("tx", touched("ol", "or")).withColumn("ty", touched("olow", "ohigh"))
    corners = plain.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("tx", tile(F.col("l"))).withColumn("ty", tile(F.col("low")))
    return corners.join(dealt, [*on, "level", "tx", "ty"]).filter(test).select("i", "o").unionByName(odd.join(o.drop("level"), on).filter(test).select("i", "o"))


def covering(points: DataFrame, spans: DataFrame, on: list[str], at: str, first: str, last: str) -> DataFrame:
    """points joined with the spans (on, first, last; whole numbers, ends included) that hold them.

    A span goes to the bins that it touches, two at most, at the level of its own length; a point to its bin at each level in use. So a key with many spans is many small joins.
    """
    length = F.col(last) - F.col(first) + 1
    s = spans.filter(F.col(first) <= F.col(last)).withColumn("__level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    levels = sorted(r["__level"] for r in s.select("__level").distinct().collect())  # 64 at most
    size = F.pow(F.lit(2.0), F.col("__level"))
    bins = lambda c: F.floor(c / size)
    s = s.withColumn("__bin", F.explode(F.sequence(bins(F.col(first)), bins(F.col(last)))))
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("__bin", bins(F.col(at)))
    return p.join(s, [*on, "__level", "__bin"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("__level", "__bin")


def _keyed(boxes: DataFrame, name: str) -> DataFrame:
    return boxes.select("page", F.struct("page", "n").alias(name), "l", "r", "t", "b")


def true_figures(boxes: DataFrame) -> DataFrame:
    """Picture boxes that hold no heading and no list item."""
    pictures, text = boxes.filter("kind = 'picture'"), boxes.filter((F.col("kind") == "text") & F.col("label").isin("section_header", "list_item"))
    held = contained(_keyed(text, "i"), _keyed(pictures, "o"), ["page"]).select("o.page", "o.n").distinct()
    return pictures.join(held, ["page", "n"], "left_anti")


def disposition(boxes: DataFrame) -> DataFrame:
    """What becomes of each text box: figure_label, in_table or body, tested in this order; captions stay in figures."""
    texts = boxes.filter("kind = 'text'")
    key = ["page", "n"]
    hit = lambda outer, name: contained(_keyed(texts, "i"), _keyed(outer, "o"), ["page"]).select("i.page", "i.n").distinct().withColumn(name, F.lit(True))
    out = texts.join(hit(true_figures(boxes), "fig"), key, "left").join(hit(boxes.filter("kind = 'table'"), "tab"), key, "left")
    return out.select(*key, F.when(F.col("fig") & (F.col("label") != "caption"), "figure_label").when(F.col("tab"), "in_table").otherwise("body").alias("disposition"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Position on the page: line band (half to even), left edge, then order of arrival."""
    w = Window.partitionBy("page").orderBy(F.bround(-F.col("t") / BAND), "l", "n")
    return boxes.select("page", "n", F.row_number().over(w).alias("place"))


def nearest(items: DataFrame, marks: DataFrame, dy: float, low: float, high: float) -> DataFrame:
    """For each item of a page the mark with the least vertical distance, at most dy, left of it by more than low and less than high."""
    near = (F.abs(F.col("i.t") - F.col("m.t")) <= dy) & (F.col("i.l") - F.col("m.l") > low) & (F.col("i.l") - F.col("m.l") < high)
    pairs = items.alias("i").join(marks.alias("m"), (F.col("i.page") == F.col("m.page")) & near)
    best = F.min_by(F.col("m.n"), F.struct(F.abs(F.col("i.t") - F.col("m.t")), F.col("m.n")))
    return pairs.groupBy(F.col("i.page").alias("page"), F.col("i.n").alias("n")).agg(best.alias("mark"))


def orphans(items: DataFrame, marks: DataFrame, dy: float, low: float, high: float) -> DataFrame:
    near = (F.abs(F.col("i.t") - F.col("m.t")) <= dy) & (F.col("i.l") - F.col("m.l") > low) & (F.col("i.l") - F.col("m.l") < high)
    return marks.alias("m").join(items.alias("i"), (F.col("i.page") == F.col("m.page")) & near, "left_anti")


def runs(points: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Maximal runs of points of a key whose neighbours are at most `gap` apart."""
    w = Window.partitionBy(key).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    rows = points.select(key, at).distinct().withColumn("new", F.coalesce(new, F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(w))
    return rows.groupBy(key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("points"))


def subtract(spans: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """Parts of the spans (key, first, last; half-open) that no hole covers: a sweep over the boundaries of each key."""
    ends = lambda d, s, h: d.filter("first < last").select(key, F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(s).alias("s"), F.lit(h).alias("h")), F.struct(F.col("last").alias("at"), F.lit(-s).alias("s"), F.lit(-h).alias("h")))).alias("e")).select(key, "e.*")
    steps = ends(spans, 1, 0).unionByName(ends(holes, 0, 1)).groupBy(key, "at").agg(F.sum("s").alias("s"), F.sum("h").alias("h"))
    w = Window.partitionBy(key).orderBy("at")
    cut = steps.select(key, "at", F.sum("s").over(w).alias("s"), F.sum("h").over(w).alias("h"), F.lead("at").over(w).alias("next"))
    open_ = cut.filter("s > 0 AND h = 0 AND next IS NOT NULL")
    # stretches that touch are one
    rows = open_.withColumn("new", F.coalesce((F.col("at") != F.lag("next").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return rows.groupBy(key, "run").agg(F.min("at").alias("first"), F.max("next").alias("last")).drop("run")
