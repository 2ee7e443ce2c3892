"""What a word table of optical character recognition is good for: lines, list markers, words that a layout lacks, operators.

words: page, n (order of arrival), block_num, par_num, line_num, left, top, width, height (pixels from the top left corner), conf, text.
items: page, n, label, text, l, r, t, b (points from the bottom left corner), as boxes have them. Every box test is an equi-join by page
with the test as residual condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import marker_ordinal
from .geometry import inside

DPI, LEAST_CONF, PAD, CENTRE_PAD = 200, 40.0, 2.0, 4.0
PAGE_SHARE, TALL, MORE_WORDS, RUN, BAND_PIXELS = 0.5, 1.8, 3, 3, 75
GUTTER, LEVELS = (60.0, 140.0), (92.0, 108.0)
#: Characters taken for one another in markers, the shape of a marker, and of one at the start of a text.
CONFUSED = ("¢©€{(º°»|I!}]>·,", "cccccooolll)))..")
MARKER = r"^(?:[0-9]{1,2}[.)]?|[a-z][.)]|[ivx]{1,4}[.)])$"
MARKER_START = r"(?U)^\s*([0-9]{1,2}|[a-zA-Z]|[ivxIVX]{1,4})\s*[.)]\s+"
OPERATORS = ("≥", "≤")
WORDS = "page int, n long, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string"
LINE = ["page", "block_num", "par_num", "line_num"]


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word table as tab-separated text with a header, nothing quoted. Numbers that are none become null."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return raw.select(*(F.expr(f"try_cast({c.split()[0]} AS {c.split()[1]})").alias(c.split()[0]) if c.split()[0] in raw.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in WORDS.split(", ")))


def points(pixels: Column, dpi: int = DPI) -> Column:
    return pixels * F.lit(72.0 / dpi)


def pixels(of: Column, dpi: int = DPI) -> Column:
    return of * F.lit(dpi / 72.0)


def to_pixels(l: Column, r: Column, t: Column, b: Column, height: Column, dpi: int = DPI) -> Column:  # noqa: E741
    """A box in points from the bottom left as pixels from the top left: struct(left, top, right, bottom)."""
    return F.struct(pixels(l, dpi).alias("left"), pixels(height - F.greatest(t, b), dpi).alias("top"), pixels(r, dpi).alias("right"), pixels(height - F.least(t, b), dpi).alias("bottom"))


def to_points(left: Column, top: Column, right: Column, bottom: Column, height: Column, dpi: int = DPI) -> Column:
    """The way back: struct(l, r, t, b)."""
    return F.struct(points(left, dpi).alias("l"), points(right, dpi).alias("r"), (height - points(top, dpi)).alias("t"), (height - points(bottom, dpi)).alias("b"))


def overlaps(a: str, b: str, pad: float = PAD) -> Column:
    """Boxes of two aliases that touch, with tolerance."""
    low, high = (lambda x: F.least(F.col(f"{x}.t"), F.col(f"{x}.b"))), (lambda x: F.greatest(F.col(f"{x}.t"), F.col(f"{x}.b")))
    apart = (F.col(f"{a}.r") < F.col(f"{b}.l") - pad) | (F.col(f"{a}.l") > F.col(f"{b}.r") + pad) | (high(a) < low(b) - pad) | (low(a) > high(b) + pad)
    return ~apart


def centre_inside(word: str, box: str, pad: float = CENTRE_PAD) -> Column:
    """The centre of a word lies in a box of pixels (left, top, right, bottom), with tolerance."""
    x, y = F.col(f"{word}.left") + F.col(f"{word}.width") / 2.0, F.col(f"{word}.top") + F.col(f"{word}.height") / 2.0
    return x.between(F.col(f"{box}.left") - pad, F.col(f"{box}.right") + pad) & y.between(F.col(f"{box}.top") - pad, F.col(f"{box}.bottom") + pad)


def kept_words(words: DataFrame, least: float = LEAST_CONF) -> DataFrame:
    return words.withColumn("text", F.trim("text")).filter((F.col("text") != "") & (F.coalesce("conf", F.lit(-1.0)) >= least) & F.col("left").isNotNull())


def lines(words: DataFrame, least: float = LEAST_CONF) -> DataFrame:
    """page, block_num, par_num, line_num, the union of the word boxes, words (from the left) and text."""
    word = F.struct("left", "n", "top", "width", "height", "text")
    rows = kept_words(words, least).groupBy(*LINE).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.array_sort(F.collect_list(word)).alias("words"))
    return rows.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def line_heads(words: DataFrame, dpi: int = DPI, order: Column | None = None) -> DataFrame:
    """The first word of each line (the leftmost, or the first in an order given), its top and the line's left edge in points."""
    w = kept_words(words, 0.0)
    head = F.min_by(F.struct("top", "text"), F.struct("left", "n", "top", "text") if order is None else order)
    return w.groupBy(*LINE).agg(head.alias("h"), F.min("left").alias("left")).select(*LINE, "h.text", points(F.col("left"), dpi).alias("l"), points(F.col("h.top"), dpi).alias("top"))


def marker_of(token: Column) -> Column:
    """A marker as it was printed, confusable characters mended; null if the token is none."""
    s = F.lower(F.translate(F.trim(token), *CONFUSED))
    return F.when(s.rlike(MARKER), s)


def gutter_markers(words: DataFrame, gutter: tuple[float, float] = GUTTER, dpi: int = DPI, order: Column | None = None) -> DataFrame:
    """Line heads in the gutter that are markers: page, l, top, marker."""
    heads = line_heads(words, dpi, order).filter((F.col("l") > gutter[0]) & (F.col("l") < gutter[1]))
    return heads.withColumn("marker", marker_of(F.col("text"))).filter("marker IS NOT NULL").select("page", "l", "top", "marker")


def continuity_breaks(marks: DataFrame, levels: tuple[float, float] = LEVELS) -> DataFrame:
    """Markers (page, l, top, marker) of one page and indent that neither follow on the one before nor begin again."""
    level = F.when(F.col("l") < levels[0], 1).when(F.col("l") < levels[1], 2).otherwise(3)
    w = Window.partitionBy("page", "level").orderBy("top", "marker", "l")
    rows = marks.withColumn("level", level).withColumn("before", F.lag("marker").over(w))
    a, b = marker_ordinal(_closed(F.col("before"))), marker_ordinal(_closed(F.col("marker")))
    return rows.filter(a.isNotNull() & b.isNotNull() & (b != a + 1) & (b != 1)).select("page", "level", "before", "marker", "top")


def _closed(marker: Column) -> Column:
    """Bare numbers get the point that ordinals ask for."""
    return F.when(marker.rlike("^[0-9]+$"), F.concat(marker, F.lit("."))).otherwise(marker)


def figures_of_pages(boxes: DataFrame, pages: DataFrame, share: float = PAGE_SHARE) -> DataFrame:
    """Picture boxes that cover less than a share of their page (page, width, height): larger ones are images of the page."""
    area = F.abs(F.col("r") - F.col("l")) * F.abs(F.col("t") - F.col("b"))
    return boxes.filter("kind = 'picture'").join(pages, "page").filter(area < share * F.col("width") * F.col("height")).drop("width", "height")


def on_row(line: DataFrame, items: DataFrame) -> DataFrame:
    """(line key, n) of items that overlap more than half of a line's height. items: page, n, left, top, right, bottom in pixels."""
    i, x = items.alias("i"), line.alias("x")
    common = F.least(F.col("x.bottom"), F.col("i.bottom")) - F.greatest(F.col("x.top"), F.col("i.top"))
    tall = F.greatest(F.lit(1.0), (F.col("x.bottom") - F.col("x.top")).cast("double"))
    return x.join(i, (F.col("x.page") == F.col("i.page")) & (common > 0.5 * tall)).select(*(F.col(f"x.{c}") for c in LINE), F.col("i.n"))


def unclaimed_runs(line: DataFrame, items: DataFrame, least: int = RUN, pad: float = CENTRE_PAD) -> DataFrame:
    """(line key, run, words, text) of consecutive words that no item on their row spans, `least` words or more."""
    spans = on_row(line, items).join(items.select("page", "n", F.col("left").alias("a"), F.col("right").alias("z")), ["page", "n"])
    word = line.select(*LINE, F.posexplode_outer("words").alias("k", "w")).filter("w IS NOT NULL")
    x = F.col("w.left") + F.col("w.width") / 2.0
    held = word.join(spans.drop("n"), LINE).filter(x.between(F.col("a") - pad, F.col("z") + pad)).select(*LINE, "k").distinct().withColumn("held", F.lit(True))
    free = word.join(held, [*LINE, "k"], "left").filter("held IS NULL")
    w = Window.partitionBy(*LINE).orderBy("k")
    runs = free.withColumn("run", F.col("k") - F.row_number().over(w))  # equal for neighbours
    got = runs.groupBy(*LINE, "run").agg(F.count("*").alias("words"), F.transform(F.array_sort(F.collect_list(F.struct("k", "w.text"))), lambda y: y["text"]).alias("texts"), F.min("k").alias("first"))
    return got.filter(F.col("words") >= least).select(*LINE, "first", "words", F.array_join("texts", " ").alias("text"))


def recovered_label(text: Column) -> Column:
    return F.when(text.rlike(MARKER_START), "list_item").otherwise("text")


def extensions(line: DataFrame, items: DataFrame, more: int = MORE_WORDS, tall: float = TALL) -> DataFrame:
    """(page, n, text): one-line items that are alone on their row and begin it, with the whole text of the row. items need text."""
    rows = on_row(line, items)
    alone = rows.groupBy(*LINE).agg(F.count("*").alias("c"), F.first("n").alias("n")).filter("c = 1").select(*LINE, "n")
    x = alone.join(line.select(*LINE, F.col("text").alias("full"), F.greatest(F.lit(1.0), (F.col("bottom") - F.col("top")).cast("double")).alias("h")), LINE)
    x = x.join(items.select("page", "n", F.trim(F.coalesce("text", F.lit(""))).alias("have"), (F.col("bottom") - F.col("top")).alias("own")), ["page", "n"])
    count = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    squash = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    fits = (F.col("own") <= tall * F.col("h")) & (count(F.col("full")) - count(F.col("have")) >= more) & (F.col("have") != "") & F.startswith(squash(F.col("full")), squash(F.col("have")))
    return x.filter(fits).select("page", "n", F.col("full").alias("text"))


def outside(items: DataFrame, blocked: DataFrame) -> DataFrame:
    """Items with a digit that touch no blocked box: where operators may be read anew."""
    return items.filter(F.col("text").rlike("[0-9]")).alias("i").join(blocked.alias("b"), (F.col("i.page") == F.col("b.page")) & overlaps("i", "b"), "left_anti")


def not_in_figures(found: DataFrame, figures: DataFrame) -> DataFrame:
    """Recovered boxes (page, l, r, t, b) outside of all figures."""
    return found.alias("x").join(figures.alias("f"), (F.col("x.page") == F.col("f.page")) & inside("x", "f"), "left_anti")


def lost_bands(bands: DataFrame, words: int = RUN, height: int = BAND_PIXELS) -> DataFrame:
    """Bands of ink (page, top, bottom, nwords, in_region) that the layout lacks: prose of one line."""
    return bands.filter((F.coalesce("nwords", F.lit(0)) >= words) & ~F.coalesce("in_region", F.lit(False)) & (F.col("bottom") - F.col("top") <= height))


def operator_counts(pages: DataFrame) -> DataFrame:
    """Words and signs of each page (page, text)."""
    t = F.col("text")
    signs = {"ge": "≥", "le": "≤", "lt": "<", "gt": ">", "times": "><", "m2": "m2", "sup2": "²"}
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    # a sum of counts: texts of a page may come in several rows
    return pages.groupBy("page").agg(F.sum(words).alias("words"), *(F.sum(F.regexp_count(t, F.lit(s))).alias(k) for k, s in signs.items()))


def tally(items: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row: texts, markers and signs of items (doc, page, text, marker) inside the given ranges, and texts outside."""
    r = ranges.select("doc", "page_from", "page_to").alias("r")
    within = items.alias("i").join(r, (F.col("i.doc") == F.col("r.doc")) & F.col("i.page").between(F.col("r.page_from"), F.col("r.page_to")), "left_semi").withColumn("here", F.lit(1))
    beyond = items.alias("i").join(r, (F.col("i.doc") == F.col("r.doc")) & F.col("i.page").between(F.col("r.page_from"), F.col("r.page_to")), "left_anti").withColumn("here", F.lit(0))
    rows = within.unionByName(beyond)
    here, text = F.col("here"), F.coalesce("text", F.lit(""))
    count = lambda s: F.coalesce(F.sum(here * F.regexp_count(text, F.lit(s))), F.lit(0)).alias({"≥": "ge", "≤": "le"}[s])
    return rows.agg(F.coalesce(F.sum(here), F.lit(0)).alias("texts"), F.coalesce(F.sum(here * (F.trim(F.coalesce("marker", F.lit(""))) != "").cast("int")), F.lit(0)).alias("markers"), count("≥"), count("≤"), F.coalesce(F.sum(1 - here), F.lit(0)).alias("tail_texts"))


def splice(base: str, other: str) -> str:
    """The base text with operators of another reading of it, where both differ by as many words in the same place."""
    from difflib import SequenceMatcher

    mine, theirs = base.split(), other.split()
    blocks = SequenceMatcher(None, mine, theirs, autojunk=False).get_matching_blocks()
    i = j = 0
    for block in blocks:
        if 0 < block.a - i == block.b - j:
            mine[i : block.a] = [t if t in OPERATORS else m for m, t in zip(mine[i : block.a], theirs[j : block.b], strict=True)]
        i, j = block.a + block.size, block.b + block.size
    return " ".join(mine)


def spliced(pairs: DataFrame) -> DataFrame:
    """Adds spliced to rows with base and other. An alignment of words has no built-in form: Arrow batches go through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [splice(a or "", b or "") for a, b in zip(batch.column("base").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield batch.append_column("spliced", pa.array(got, pa.string()))

    return pairs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", spliced string")
