"""Main text of web pages: site templates go by the subtrees that recur, the rest by markup.

Each page is parsed in one pass that closes optional end tags. Every element's subtree gets a hash (tag,
class, id, texts and children). Spark counts, for each host, on how many distinct pages a subtree stands: pages of one host
with the same texts count as one. A subtree that stands on `LEAST_PAGES` of them recurs, at any size of the host.

Prose recurs as well: a sentence, a quoted passage, "Yes." in a table. So what can be template depends on what an element is. Inside what the
page declares as its content (article or main) only elements with a class or id, or mostly links, can be. Elsewhere others can be too,
but a single block without name only together with a neighbour: it recurs if it stands after, or before, the same block on `LEAST_PAGES` pages.

A near copy of a page consists of recurring subtrees too. So only pages of which recurring subtrees aren't the bulk are
witnesses, and a subtree is template if `LEAST_PAGES` witnesses have it. Templates are deleted from every page of that
host, unless they would take the bulk of it. The
bulk is more than half of the text outside links that the page would return else (of all its text, if all is links).

Elements that are no content by their own markup (menus, forms, adverts, notices, comments, ...)
go too, wherever they stand, which also covers hosts with few pages. Names of class and id count as whole tokens: one of `WORDS`, alone or together with words
that name a part of a page (`sidebar`, `cookie-banner`, `comment-list`, but not `share-price`). They tell nothing
where they hold nearly all prose of the page or its main element: that is a wrapper. What a page declares as its content is
taken where there is any.

The parser reads a page once, in time linear in its length whatever the markup: ends of tags and quotes that are found missing once are not looked for again,
and open elements are counted by name.

Recurring subtrees are kept as sorted arrays of 64-bit keys of host and subtree, in files of about `SMALL` keys in the
shared folder. Workers memory-map them, so neither their number nor a hot host matters.

Edge cases: a null html is an empty page with an empty text; a null or odd url counts under the empty
host; repeated rows count as one page; an empty table gives an empty table; other columns pass through,
the new column replaces an input column of its name. Unclosed comments, tags and raw elements run to the end.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, shared_path, stored, tidy
from .files import Store
from .kneser_ney import _place, pair

LEAST_PAGES, SMALL = 5, 1_000_000
#: Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
JUNK = frozenset("nav footer aside form button dialog menu".split())
MAIN = frozenset("article main".split())
#: Words in class or id that mark what isn't content.
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr newsletter
    subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus replies related
    share sharing social popup modal overlay login search pagination pager widget toolbar copyright""".split()
)
#: Which open element a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_OPENS = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_STOPS = re.compile(r"""[>"']""")
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Words that name a part of a page, beside which one of WORDS keeps its meaning in a class name.
PARTS = frozenset(
    """box boxes list lists block blocks bar area wrap wrapper container section row col column inner outer panel link links item items button buttons btn icon icons
    site page main top bottom left right header head global primary secondary tertiary mobile desktop sticky fixed text form thread reply body
    posts articles stories news slot unit zone group set tags js""".split()
)
#: Elements that optional end tags don't reach across.
CONTAINERS = frozenset("ul ol dl table".split())
#: What an element that names marks as no content may hold of a page's prose, in percent.
WRAPPER = 90


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def marks(token: str) -> bool:
    """Whether a class or id says that an element isn't content: it consists of such words, and of words for parts of a page."""
    words = _WORD.findall(token)
    return not WORDS.isdisjoint(words) and all(w in WORDS or w in PARTS for w in words)


class Page:
    """Blocks of text in order, and the element subtrees with the blocks that each covers."""

    def __init__(self, source: str | None):
        self.blocks: list[str] = []
        self.junk: list[bool] = []
        self.main: list[bool] = []
        self.linked: list[int] = []  # characters of each block that are in links
        self.upto = [(0, 0)]  # characters, and those in links, before each block
        #: (hash, first block, block after the last, whether it counts together with its neighbours only)
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self.named: list[tuple[int, int, int]] = []  # elements that are no content by name: first block, block after the last, main elements inside
        self.mains = 0
        self.run: list[str] = []
        self.links = self.in_links = 0  # open links, and characters of the run inside links
        self.state = [False, False]  # inside junk, inside main
        # of each open element: tag, parts for the hash, first block, state outside, main elements before it if its name marks it (else -1), whether it has a name
        self.open: list[tuple[str, list[str], int, list[bool], int, bool]] = [("", [], 0, [False, False], -1, False)]
        self.counts: dict[str, int] = {}  # open elements by tag
        self.scopes: list[tuple[int, dict[str, int]]] = [(0, {})]  # of each open block element: its place, and the inline elements open in it
        self.lists: list[int] = []  # places of open elements that optional end tags depend on
        self.parse(source or "")

    def parse(self, source: str) -> None:
        at, n, low, missing = 0, len(source), None, set()
        budget = 16 * n + 1024  # characters to look at for the ends of tags, in all

        def find(what: str, start: int) -> int:
            """As source.find, but never twice for what isn't there any more."""
            if what in missing:
                return -1
            k = source.find(what, start)
            if k < 0:
                missing.add(what)
            return k

        def tag_end(start: int) -> int:
            """The place of the > that ends a tag: the first one outside quotes, or the first one if quotes don't close; -1 if there is none."""
            nonlocal budget
            i = start
            while budget > 0:
                m = _STOPS.search(source, i)
                if not m:
                    break
                budget -= m.end() - i
                if m[0] == ">":
                    return m.start()
                k = find(m[0], m.end())
                if k < 0:
                    break
                budget -= k - m.end()
                i = k + 1
            return find(">", start)

        def text(end: int) -> None:
            if end > at:
                self.run.append(entities.unescape(source[at:end]))
                if self.links:
                    self.in_links += len(" ".join(self.run[-1].split()))

        while at < n:
            m = _OPENS.search(source, at)
            text(m.start() if m else n)
            if not m:
                break
            if m[0] == "<!--":
                k = find("-->", m.end())
                at = n if k < 0 else k + 3
                continue
            k = tag_end(m.end()) if m[2] else find(">", m.end())
            if k < 0:
                break  # a tag that doesn't end runs to the end of the page
            at, tag, attributes = k + 1, (m[2] or "").lower(), source[m.end() : k]
            if not tag:
                continue
            if m[1]:
                self.end(tag)
            elif tag in RAW and not attributes.endswith("/"):
                low = source.lower() if low is None else low
                if len(low) != n:  # lower-casing changed lengths: look for the end as it is written
                    found = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                    close = found.start() if found else -1
                else:
                    close = low.find(f"</{tag}", at)
                at = n if close < 0 else (source.find(">", close) + 1 or n)
            else:
                self.start(tag, attributes)
        while len(self.open) > 1:
            self.close()
        self.flush()

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            linked, self.in_links, self.run = self.in_links, 0, []
            if text:
                self.blocks.append(text)
                self.linked.append(min(linked, len(text)))
                self.upto.append((self.upto[-1][0] + len(text), self.upto[-1][1] + self.linked[-1]))
                self.junk.append(self.state[0])
                self.main.append(self.state[1])
                self.open[-1][1].append(text)

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("br", "hr"):
            self.run.append(" ")
        if tag in BLOCK:
            self.flush()
            if self.open[self.scopes[-1][0]][0] == "p":  # a block ends an open paragraph and what is open inside it
                self.close_to(self.scopes[-1][0])
        if tag in VOID:
            return
        if tag in ENDS:
            outermost = 0
            for k in reversed(self.lists):
                other = self.open[k][0]
                if other in ENDS[tag]:
                    outermost = k
                elif other in CONTAINERS or other == "tr":
                    break
                if other == tag:
                    break
            if outermost:
                self.close_to(outermost)
        named = " ".join("".join(x) for x in _NAMED.findall(attributes)).lower() if attributes else ""
        outside = self.state
        junk = tag in JUNK or tag == "header" and not outside[1]
        marked = bool(named) and tag not in ("html", "body", "main") and any(map(marks, named.split()))
        main = tag in MAIN or "role" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes) is not None
        if tag in BLOCK:
            self.scopes.append((len(self.open), {}))
        else:
            inline = self.scopes[-1][1]
            inline[tag] = inline.get(tag, 0) + 1
        if tag in ENDS or tag in CONTAINERS:
            self.lists.append(len(self.open))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.open.append((tag, [f"<{tag} {named}>"], len(self.blocks), outside, self.mains if marked else -1, bool(named)))
        self.mains += main and tag != "article"
        self.links += tag == "a"
        if junk or main:
            self.state = [outside[0] or junk, outside[1] or main and not junk and not marked]

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not (self.counts.get(tag) if tag in BLOCK else self.scopes[-1][1].get(tag)):
            return  # there is none to end, or it holds the block that is open
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.close_to(k)
                return

    def close_to(self, place: int) -> None:
        while len(self.open) > place:
            self.close()

    def close(self) -> None:
        tag, parts, first, outside, mains, named = self.open[-1]
        if tag in BLOCK:
            self.flush()
        inside = self.state
        self.open.pop()
        self.counts[tag] -= 1
        if tag in BLOCK:
            self.scopes.pop()
        else:
            self.scopes[-1][1][tag] -= 1
        if self.lists and self.lists[-1] == len(self.open):
            self.lists.pop()
        self.links -= tag == "a"
        whole = xxhash.xxh64_intdigest("\x00".join(parts)) >> 1
        self.open[-1][1].append(f"{whole:x}")
        self.state = outside
        last = len(self.blocks)
        if mains >= 0 and last > first:
            self.named.append((first, last, self.mains - mains))
        if last > first and tag in BLOCK and tag not in ("html", "body"):
            strong = named or 2 * (self.upto[last][1] - self.upto[first][1]) > self.upto[last][0] - self.upto[first][0]
            if strong or not inside[1]:
                self.subtrees.append((whole, first, last, not strong and last - first == 1))

    def returned(self) -> list[bool]:
        """Which blocks are text of the page by markup."""
        prose = np.array([0 if j else len(t) - n for j, t, n in zip(self.junk, self.blocks, self.linked, strict=True)], np.int64)
        upto = np.append(0, np.cumsum(prose))
        most, edges = WRAPPER * int(upto[-1]), np.zeros(len(prose) + 1, np.int64)
        for first, last, mains in self.named:
            if not mains and 100 * int(upto[last] - upto[first]) <= most:
                edges[first] += 1
                edges[last] -= 1
        gone = np.array(self.junk, bool) | (np.cumsum(edges)[:-1] > 0)
        main = np.array(self.main, bool)
        return (~gone & (main | ~(main & ~gone).any())).tolist()

    def weights(self) -> np.ndarray:
        """Of each block: its characters outside links (or all, if the page has no others), 0 where markup drops it."""
        mine = np.array(self.returned(), np.int64)
        size = np.array([len(t) for t in self.blocks], np.int64) * mine
        prose = size - np.array(self.linked, np.int64) * mine
        return prose if prose.any() else size

    def marked(self) -> list[tuple[int, int, int]]:
        """(hash, first block, block after the last) of the subtrees; those that count with their neighbours only stand twice, with the block before and the one after."""
        out = []
        for whole, first, last, weak in self.subtrees:
            if not weak:
                out.append((whole, first, last))
                continue
            for side, k in (("<", first - 1), (">", last)):
                near = self.blocks[k] if 0 <= k < len(self.blocks) else ""
                out.append((xxhash.xxh64_intdigest(f"{whole:x}{side}{near}") >> 1, first, last))
        return out

    def keys(self, host: str) -> np.ndarray:
        """Of each subtree: the key of host and hash."""
        return pair(np.uint64(xxhash.xxh64_intdigest(host)), np.array([x[0] for x in self.marked()], np.uint64)).view(np.int64)

    def spans(self) -> np.ndarray:
        return np.array([x[1:] for x in self.marked()], np.int64).reshape(-1, 2)

    def text(self, gone: np.ndarray) -> str:
        return "\n\n".join(t for t, mine, g in zip(self.blocks, self.returned(), gone, strict=True) if mine and not g)


def covered(spans: np.ndarray, weights: np.ndarray) -> np.ndarray | None:
    """Which blocks the given subtrees cover; None if that is the bulk of the page."""
    edges = np.bincount(spans[:, 0], minlength=len(weights) + 1) - np.bincount(spans[:, 1], minlength=len(weights) + 1)
    gone = np.cumsum(edges)[:-1] > 0
    return None if 2 * int(weights[gone].sum()) > int(weights.sum()) else gone


@dataclass
class Keys:
    """A set of keys in files of the shared folder, as each task opens it."""

    folder: str
    slices: int
    there: frozenset[int]

    def open(self):
        store, files = Store(self.folder), {}

        def among(keys: np.ndarray) -> np.ndarray:
            out, slot = np.zeros(len(keys), bool), keys % self.slices
            for k in set(slot.tolist()) & self.there:
                if k not in files:
                    files[k] = store.mapped(f"keys-{k}").view(np.int64)
                mine = slot == k
                out[mine] = _place(files[k], keys[mine])[1]
            return out

        return among


def kept(keys: DataFrame, name: str) -> Keys:
    """Writes distinct keys (key) as sorted arrays."""
    keys = stored(keys.select("key"), name)
    folder, slices = shared_path(keys.sparkSession, name), keys.count() // SMALL + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            k = batch.column("key").to_numpy()
            for slot in np.unique(k % slices).tolist():
                parts.setdefault(slot, []).append(k[k % slices == slot])
        for slot, found in parts.items():
            Store(folder).write(f"keys-{slot}", np.sort(np.concatenate(found)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64())], ["slot"])

    dealt = keys.repartition(slices, F.pmod("key", F.lit(slices))).mapInArrow(tidy(run), "slot long")
    return Keys(folder, slices, frozenset(r["slot"] for r in dealt.collect()))


def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
    """(key, pages) of the distinct keys of each page."""
    k, n = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "pages"])


def templates(pages: DataFrame) -> Keys:
    """The subtrees that recur on a host. Rows of equal texts are merged first; then pages are counted within tasks, and by key."""
    packed = "keys binary, spans binary, weights binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
                page, host = Page(source.as_py()), host_of(url)
                if page.subtrees:
                    same = xxhash.xxh3_128_digest("\x00".join([host, *page.blocks]))
                    out.append((same, page.keys(host).tobytes(), page.spans().astype(np.uint32).tobytes(), page.weights().astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in range(4)], ["page", "keys", "spans", "weights"])

    def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k, s, w in zip(*(batch.column(c).to_pylist() for c in ("keys", "spans", "weights")), strict=True):
            yield np.frombuffer(k, np.int64), np.frombuffer(s, np.uint32).reshape(-1, 2), np.frombuffer(w, np.uint32).astype(np.int64)

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield counted([np.unique(k) for k, _, _ in unpacked(batch)])

    def witness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = recurring.open()
        for batch in batches:
            found = []
            for k, spans, weights in unpacked(batch):
                there = among(k)
                if covered(spans[there], weights) is not None:
                    found.append(np.unique(k[there]))
            yield counted(found)

    def often(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)

    rows = pages.select("url", "html").mapInArrow(tidy(parse), f"page binary, {packed}")
    distinct = stored(rows.groupBy("page").agg(F.min(F.struct("keys", "spans", "weights")).alias("p")).select("p.*"), "pages")  # of copies any, but always the same
    recurring = kept(often(distinct.mapInArrow(tidy(recur), "key long, pages long")), "recurring")
    return kept(often(distinct.mapInArrow(tidy(witness), "key long, pages long")), "templates")


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds the main text of each page; needs the columns url and html."""
    keep = [c for c in pages.columns if c != text]
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(text, T.StringType(), False)])
    found = templates(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = found.open()
        for batch in batches:
            out = []
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html"), strict=True):
                page = Page(source.as_py())
                gone = covered(page.spans()[among(page.keys(host_of(url)))], page.weights())
                out.append(page.text(np.zeros(len(page.blocks), bool) if gone is None else gone))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, text])

    return map_rows(pages, run, schema)
