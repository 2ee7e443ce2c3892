"""From laid-out documents to records: drop what is no text, order by reading position, nest by printed numbering, mint ids.

Everything that concerns an item alone, and all box tests, are column expressions and equi-joins by page. What is
left for Python is the state that runs through a document (open headings, open list items, ids given): one grouped
map by document, whose rows already carry their parsed cites.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import stored
from .analytics import gap_fill
from .geometry import BAND, SLACK, contained

#: Labels of page furniture.
FURNITURE = ("page_header", "page_footer")
UNNUMBERED = 99
#: Items in figures or in tables that go to all items.
FEW = 100_000


def _boxes(items: DataFrame, kind: str) -> DataFrame:
    """Every box of an item, for these may stand on several pages."""
    p = items.filter(F.col("kind") == kind).select("doc", F.posexplode("prov").alias("k", "p"), "at")
    return p.select("doc", "at", "k", F.col("p.page_no").alias("page"), F.col("p.bbox").alias("box"))


def _placed(rows: DataFrame, name: str, key: list[str], box: str) -> DataFrame:
    return rows.select("doc", "page", F.struct(*key).alias(name), *(F.col(f"{box}.{c}").alias(c) for c in "lrtb"))


def figures(items: DataFrame) -> DataFrame:
    """Picture boxes, but for those that hold a heading or a list item: such a box is a page image, no figure."""
    f, key = _boxes(items, "picture"), ["doc", "at", "k"]
    heads = items.filter((F.col("kind") == "text") & F.col("label").isin("section_header", "list_item"))
    held = contained(_placed(heads, "i", ["doc", "kind", "at"], "bbox"), _placed(f, "o", key, "box"), ["doc", "page"])
    return f.join(held.select("o.*").distinct(), key, "left_anti")


def _flag(items: DataFrame, boxes: DataFrame, name: str) -> DataFrame:
    """(doc, kind, at) of the text items that lie in one of the boxes. Up to `FEW` go to the items, whose texts then aren't shuffled for them."""
    hit = contained(_placed(items.filter("kind = 'text'"), "i", ["doc", "kind", "at"], "bbox"), _placed(boxes, "o", ["doc", "at", "k"], "box"), ["doc", "page"])
    flagged = stored(hit.select("i.*").distinct().withColumn(name, F.lit(True)), name)
    return F.broadcast(flagged) if flagged.count() <= FEW else flagged


def grid_text(data: Column) -> Column:
    """A table's cells as text; null if there is nothing to show. Of cells at one place the last wins; cells outside are left out."""
    rows, cols, cells = F.coalesce(data["num_rows"], F.lit(0)), F.coalesce(data["num_cols"], F.lit(0)), F.coalesce(data["table_cells"], F.array().cast("array<struct<start_row_offset_idx:int,start_col_offset_idx:int,text:string>>"))

    def at(i: Column, j: Column) -> Column:
        here = F.filter(cells, lambda c: (F.coalesce(c["start_row_offset_idx"], F.lit(0)) == i) & (F.coalesce(c["start_col_offset_idx"], F.lit(0)) == j))
        return F.trim(F.coalesce(F.try_element_at(here, F.lit(-1))["text"], F.lit("")))

    lines = F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.array_join(F.transform(F.sequence(F.lit(0), cols - 1), lambda j: at(i, j)), " | "))
    some = F.exists(cells, lambda c: F.trim(F.coalesce(c["text"], F.lit(""))) != "")
    return F.when((rows > 0) & (cols > 0) & some, F.array_join(lines, " ¶ "))


def prepared(items: DataFrame) -> DataFrame:
    """Each item with its disposition, its text and its parsed cites, in a form that needs no look at other items."""
    key = ["doc", "kind", "at"]
    x = items.join(_flag(items, figures(items), "in_figure"), key, "left").join(_flag(items, _boxes(items, "table"), "in_table"), key, "left")
    label, raw = F.col("label"), F.trim(X.collapse(F.coalesce("text", F.lit(""))))
    bare = F.trim(F.regexp_replace(raw, X.RUNNING_HEADER, ""))
    captions = F.coalesce("captions", F.array().cast("array<struct<text:string>>"))
    caption = F.trim(F.array_join(F.transform(captions, lambda c: F.coalesce(c["text"], F.lit(""))), " "))
    caption_cite = F.try_element_at(F.filter(F.transform(captions, lambda c: X.parse_cite(F.coalesce(c["text"], F.lit("")))["cite"]), lambda c: c.isNotNull()), F.lit(1))
    furniture = F.coalesce(label.isin(*FURNITURE), F.lit(False)) | F.coalesce(F.col("content_layer") == "furniture", F.lit(False))
    x = x.withColumn("grid", F.when(F.col("kind") == "table", grid_text(F.col("data"))))
    body = F.when(F.col("kind") == "picture", caption).when(F.col("kind") == "table", F.col("grid")).otherwise(bare)
    drop = (
        F.when(furniture, "furniture")
        .when((F.col("kind") == "text") & F.col("in_figure") & ~F.coalesce(label == "caption", F.lit(False)), "figure_labels")
        .when((F.col("kind") == "text") & F.col("in_table"), "in_table")
        .when((F.col("kind") == "table") & F.col("grid").isNull(), "tables_skipped")
        .when((F.col("kind") == "text") & (raw == ""), "empty")
        .when((F.col("kind") == "text") & (bare == ""), "running_header")
    )
    promoted = (F.col("kind") == "text") & label.isin("list_item", "text") & (F.length(bare) <= X.HEADING_LENGTH) & bare.rlike(X.HEADING)
    x = x.select(*key, "kind_order", "page", "bbox", "marker", drop.alias("dropped"), body.alias("body"), F.when(F.col("kind") != "text", F.col("kind")).when(promoted, "section_header").otherwise(label).alias("label"), label.alias("was"), caption_cite.alias("caption_cite"))
    head = X.parse_cite(F.col("body"))
    own = F.trim(F.coalesce("marker", F.lit("")))
    inline = F.when(F.col("label") == "list_item", F.regexp_extract("body", X.INLINE_MARKER, 1)).otherwise("")
    is_head = F.col("label") == "section_header"
    x = x.withColumn("head", F.when(is_head, head))
    cite = F.when(F.col("kind") != "text", F.col("caption_cite")).when(is_head, F.col("head.cite")).when(X.is_marker(own), own).otherwise(inline)
    top = F.when(F.col("bbox.coord_origin") == "BOTTOMLEFT", -F.col("bbox.t")).otherwise(F.col("bbox.t"))
    return x.withColumn("cite", F.coalesce(cite, F.lit(""))).select(
        *key, "kind_order", "page", "dropped", "label", "was", "body", "cite", X.cite_path(F.col("cite")).alias("path"), F.coalesce("head.kind", F.lit("")).alias("cite_kind"), F.coalesce("head.rank", F.lit(0)).alias("rank"),
        F.bround(F.coalesce(top, F.lit(0.0)) / BAND).alias("band"), F.coalesce("bbox.l", F.lit(0.0)).alias("left"),
    )


class Outline:
    """The open headings of a document, outermost first: (parts of the number, rank, id). Rank 0 is a dotted number."""

    def __init__(self) -> None:
        self.open: list[tuple[tuple[str, ...], int, str]] = []

    def top(self) -> str:
        return self.open[-1][2] if self.open else ""

    def enter(self, parts: tuple[str, ...], rank: int, ident: str) -> str:
        """Closes what the new heading ends, and opens it; returns its parent."""

        def ends(other: tuple[tuple[str, ...], int, str]) -> bool:
            theirs, level, _ = other
            if rank == UNNUMBERED:
                return level == UNNUMBERED
            if rank:  # a namespace ends all but coarser namespaces
                return not level or level >= rank
            return level == UNNUMBERED or (not level and not (len(theirs) < len(parts) and parts[: len(theirs)] == theirs))

        while self.open and ends(self.open[-1]):
            self.open.pop()
        parent = self.top()
        self.open.append((parts, rank, ident))
        return parent


def nest(rows: pd.DataFrame) -> pd.DataFrame:
    """Ids and parents of one document's items, which come in any order."""
    rows = rows.sort_values(["page", "band", "left", "kind_order", "at"], kind="stable").reset_index(drop=True)
    outline, lists, given, counts = Outline(), [], set(), defaultdict(int)
    ids, parents = [], []

    def mint(code: str, page: int, path: str) -> str:
        if not path:
            counts[page] += 1
            path = f"§{counts[page]}"
        first = ident = f"{code}:p{page}:{path}"
        n = 1
        while ident in given:
            n += 1
            ident = f"{first}~{n}"
        given.add(ident)
        return ident

    for r in rows.itertuples():
        parent = outline.top()
        if r.kind == "text" and r.label == "section_header":
            ident = mint(r.code, r.page, r.path)
            parts, rank = ((), UNNUMBERED) if not r.cite_kind else (tuple(r.path.split(".")), 0) if r.cite_kind == "num" else ((), int(r.rank))
            parent = outline.enter(parts, rank, ident)
            lists.clear()
        elif r.kind == "text":
            if r.label == "list_item":
                while lists and lists[-1][0] >= r.left - SLACK:
                    lists.pop()
                parent = lists[-1][1] if lists else parent
            above = parent.split(":", 2)[2] if parent.count(":") > 1 else ""
            ident = mint(r.code, r.page, f"{above}.{r.path}" if r.path and above and above[0] != "§" else r.path)
            if r.label == "list_item":
                lists.append((r.left, ident))
        else:
            ident = mint(r.code, r.page, r.path)
        ids.append(ident)
        parents.append(parent)
    return pd.DataFrame({"seq": range(len(rows)), "id": ids, "doc": rows["code"], "page": rows["page"], "cite": rows["cite"], "parent_id": parents, "label": rows["label"], "body": rows["body"]})


def build(items: DataFrame, ocr: DataFrame | None = None, by: str = "doc") -> DataFrame:
    """The records of all documents; seq counts within a document, or (by="code") within documents that share a code, whose pages then run together."""
    rows = prepared(items).filter("dropped IS NULL").withColumn("code", X.doc_code(F.col("doc")))
    out = rows.groupBy(by).applyInPandas(nest, "seq long, id string, doc string, page int, cite string, parent_id string, label string, body string")
    if ocr is not None:
        spans = ocr.select(X.doc_code(F.col("doc")).alias("d"), "page_from", "page_to")
        hit = out.alias("o").join(spans.alias("s"), (F.col("o.doc") == F.col("s.d")) & F.col("o.page").between(F.col("s.page_from"), F.col("s.page_to")), "left_semi").select("id").distinct().withColumn("ocr", F.lit(True))
        out = out.join(hit, "id", "left")
    else:
        out = out.withColumn("ocr", F.lit(False))
    fixed = X.repair(F.col("body"), F.coalesce("ocr", F.lit(False)))
    return out.withColumn("text", fixed).withColumn("norm", X.normalize(F.col("text"))).select("seq", "id", "doc", "page", "cite", "parent_id", "label", "text", "norm")


def tally(items: DataFrame) -> DataFrame:
    """(what, n): how many items were dropped for each reason, and kept of each kind."""
    x = prepared(items)
    what = F.coalesce("dropped", F.when(F.col("kind") == "picture", "pictures").when(F.col("kind") == "table", "tables").when(F.col("label") == "section_header", "headings").otherwise("body"))
    return x.groupBy(what.alias("what")).agg(F.count("*").alias("n"))


def counters(items: DataFrame) -> DataFrame:
    """(what, n): headings that were list items or texts, headings and other items without a cite, and picture boxes that are no figures."""
    x = prepared(items).filter("dropped IS NULL")
    head = (F.col("kind") == "text") & (F.col("label") == "section_header")
    kept = x.agg(
        F.count_if(head & ~F.coalesce(F.col("was") == "section_header", F.lit(False))).alias("promoted_headings"), F.count_if(head & (F.col("cite_kind") == "")).alias("unnumbered_headings"),
        F.count_if((F.col("kind") == "text") & ~head & (F.col("cite") == "")).alias("unaddressed_items"),
    )
    boxes = _boxes(items, "picture").agg(F.count("*").alias("all")).join(figures(items).agg(F.count("*").alias("true"))).select((F.col("all") - F.col("true")).alias("figure_boxes_disqualified"))
    names = ("promoted_headings", "unnumbered_headings", "unaddressed_items", "figure_boxes_disqualified")
    return kept.join(boxes).select(F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")


def provenance(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Ranges of all pages with their source, by document code."""
    return gap_fill(ocr, pages).select(X.doc_code(F.col("doc")).alias("doc"), "page_from", "page_to", "source")
