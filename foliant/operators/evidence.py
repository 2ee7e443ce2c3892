"""What an answer carries beyond its records: citation lines, pointers one hop on, routes checked against exact search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, strip_accents
from ..storage import ranked, stored
from .gates import printed_pages
from .order import extremes, order_labels, preceding, with_ancestors
from .search import ancestry

#: Shapes of a pointer to another unit, of a unit outside the corpus, and nouns that name figures.
POINTER = (
    r"(?iU)\b(art[íi]culo|art\.|apartado|tabla|anejo|anexo|secci[óo]n|cap[íi]tulo|figura|gr[áa]fico|punto)\s+"
    r"((?:SUA\s*)?[A-Z]{0,4}[0-9IVX]+(?:[.\-][0-9IVX]+)*|[A-Z])\b"
)
EXTERNAL = r"(?iU)\b(Ley|Real Decreto|RD|Decreto|Reglamento)\s+[0-9/]+|(?iU)\bDB[- ]S[IEH]\b|(?iU)\bCTE\b"
FIGURES = r"(?iU)^(figura|gr[áa]fico)$"
EXTERNAL_WINDOW = 60
#: Pairs of words (as hashes) or documents that go to the texts, documents of one part of a group, records of one part of those that hold a name.
KNOWN, PART, HITS = 1_000_000, 256, 50_000
#: What readers of an optical text may take for one another.
VARIANTS = {"0": "o", "o": "0", "y": "Y", "Y": "y"}
CITE_PREFIX = r"^([A-Za-z]?[0-9]+(?:\.[0-9]+)*|[A-Z]\.[0-9](?:\.[0-9])*)"


def pointers(r: DataFrame, column: str = "text", pointer: str = POINTER, external: str = EXTERNAL, figure: str = FIGURES, window: int = EXTERNAL_WINDOW) -> DataFrame:
    """(id, doc, k, noun, address, kind) of every pointer in a text: kind is figure, external (another source is named within the window after it) or in_corpus."""
    # the pattern again at each place: extract_all gives what follows a match only with it
    whole = F.regexp_extract_all(column, F.lit(f"(?s)(?:{pointer})(?=(.{{0,{window}}}))"), F.lit(0))
    ahead = F.regexp_extract_all(column, F.lit(f"(?s)(?:{pointer})(?=(.{{0,{window}}}))"), F.lit(3))
    rows = r.select("id", "doc", F.posexplode_outer(F.arrays_zip(whole.alias("m"), ahead.alias("after"))).alias("k", "x")).filter("x IS NOT NULL")
    noun, address = F.regexp_extract("x.m", pointer, 1), F.regexp_extract("x.m", pointer, 2)
    kind = F.when(noun.rlike(figure), "figure").when(F.col("x.after").rlike(external), "external").otherwise("in_corpus")
    return rows.select("id", "doc", "k", noun.alias("noun"), address.alias("address"), kind.alias("kind"))


def pointer_counts(r: DataFrame, found: DataFrame) -> DataFrame:
    """Per document: records, pointers of each kind, and records with one."""
    n = found.groupBy("doc").agg(F.count("*").alias("pointers"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("in_corpus", "external", "figure")), F.count_distinct("id").alias("with_pointer"))
    return r.groupBy("doc").agg(F.count("*").alias("records")).join(n, "doc", "left").na.fill(0)


def expanded(found: DataFrame, r: DataFrame) -> DataFrame:
    """(id, k, target): every record that bears the cite of an in-corpus pointer, one hop on; never further."""
    targets = r.filter("cite <> ''").select(F.col("cite").alias("address"), F.col("id").alias("target"), F.col("doc").alias("target_doc"))
    return found.filter("kind = 'in_corpus'").join(targets, "address").select("id", "k", "address", "target", "target_doc")


def envelope(found: DataFrame, opened: DataFrame) -> DataFrame:
    """(id, opened) of a result: every id found, and whether it was opened."""
    marks = opened.select("id").distinct().withColumn("open", F.lit(True))
    return found.select("id").distinct().join(marks, "id", "left").select("id", F.coalesce("open", F.lit(False)).alias("opened"))


def envelope_counts(shown: DataFrame) -> DataFrame:
    """How many ids were found, how many opened, and how many stay unopened."""
    return shown.agg(F.count("*").alias("found"), F.count_if("opened").alias("opened"), F.count_if(~F.col("opened")).alias("unopened"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, once: bool = False, text: str = "norm") -> DataFrame:
    """(id, phrase) of texts (id) that hold a phrase (phrase) as whole words, whatever stands between the words.

    Any number of phrases: each is looked for by its rarest pair of neighbouring words (or its only word), so a frequent one decides nothing. Texts give up only
    the places of such pairs, with the words around them if a phrase is longer, and what is joined there is verified. Up to `KNOWN` pairs go to the texts as hashes,
    so nothing else of a text is shuffled. once: no two texts share an id, so hits of phrases of one or two words, which also go to the texts, aren't shuffled either.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"))
    asked = stored(phrases.select("phrase").distinct().select("phrase", words(F.col("phrase")).alias("ws")).filter("size(ws) > 0"), "phrases")
    longest = asked.agg(F.max(F.size("ws"))).first()[0]
    if longest is None:
        return texts.select("id", F.lit("").alias("phrase")).limit(0)
    pairs = F.transform(F.expr("slice(ws, 1, greatest(size(ws) - 1, 0))"), lambda w, i: F.concat(w, F.lit(" "), F.get("ws", i + 1)))
    at = asked.select("phrase", "ws", F.posexplode(F.when(F.size("ws") > 1, pairs).otherwise(F.col("ws"))).alias("k", "w"))
    units = stored(at.select(F.xxhash64("w").alias("h")).distinct(), "units")
    units = F.broadcast(units) if units.count() <= KNOWN else units
    said = texts.select("id", words(F.coalesce(F.col(text), F.lit(""))).alias("ws"))  # a filter on their number would work the words out twice
    alone = asked.filter("size(ws) = 1").limit(1).count() > 0
    whole = lambda c: c.withColumn("h", F.xxhash64("w")).join(units, "h", "left_semi").drop("h")
    if longest <= 2:
        said = said.select("id", F.explode_outer(F.array_distinct(F.concat(pairs, F.col("ws")) if alone else pairs)).alias("w")).filter("w IS NOT NULL")
        at = at.select("w", "phrase")
        met = whole(said).join(F.broadcast(at) if asked.count() <= KNOWN else at, "w").select("id", "phrase")
        return met if once else met.distinct()
    place = lambda w, i: F.struct(w.alias("w"), F.least(i, F.lit(longest - 1)).alias("back"), F.slice("ws", F.greatest(i - (longest - 2), F.lit(1)), F.lit(2 * longest - 1)).alias("near"))
    around = F.transform(pairs, place)
    around = F.concat(around, F.transform("ws", place)) if alone else around
    places = whole(said.select("id", F.explode_outer(around).alias("p")).filter("p IS NOT NULL").select("id", "p.*"))
    used = places.groupBy("w").agg(F.count("*").alias("n"))
    known = at.join(used, "w").groupBy("phrase").agg(F.min_by(F.struct("w", "k", "ws"), F.struct("n", "k")).alias("x"), F.count_distinct("k").alias("there"))
    # a phrase with a pair that no text has isn't anywhere
    keys = stored(known.select("phrase", "x.w", "x.k", "x.ws", "there").filter("there = greatest(size(ws) - 1, 1)").drop("there"), "keys")
    hit = places.join(keys, "w")
    return hit.filter((F.col("back") >= F.col("k")) & (F.slice("near", F.col("back") - F.col("k") + 1, F.size("ws")) == F.col("ws"))).select("id", "phrase").distinct()


def deference(r: DataFrame, names: DataFrame, once: bool = False) -> DataFrame:
    """(id, doc, target): records that name another document (names: doc, name), followed one hop. Any number of names, met as whole words.

    Documents with the same names are one group, kept as arrays of some `PART` documents, until the last join, after which nothing is shuffled: its rows are as many
    as the answer's, and what is shuffled before grows with names and met names only. Up to `KNOWN` documents go to the met names; beyond, a name that is met often
    is dealt in parts of some `HITS` records, so that no task has one whole. once: no two records share an id, so met names needn't be told apart by a shuffle.
    """
    names = stored(names.filter("name IS NOT NULL"), "names")
    found = phrase_hits(r.select(F.struct("id", "doc").alias("id"), "norm"), names.select(F.col("name").alias("phrase")), once)
    named = stored(names.groupBy(F.col("doc").alias("target")).agg(F.array_sort(F.collect_set("name")).alias("names")), "named")
    # groups of more than one part are few: one for each `PART` documents at most
    large = stored(named.groupBy("names").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).filter("parts > 1"), "large")
    part = F.pmod(F.xxhash64("target"), F.coalesce("parts", F.lit(1))).alias("part")
    members = named.join(F.broadcast(large), "names", "left").groupBy("names", part).agg(F.collect_list("target").alias("targets"))
    members = stored(members.drop("part"), "members")
    if named.filter("size(names) > 1").limit(1).count():
        hit = found.join(named.select("names").distinct().select("names", F.explode("names").alias("phrase")), "phrase").select("id", "names").distinct()
    else:
        hit = found.select("id", F.array("phrase").alias("names"))
    if named.count() <= KNOWN:
        out = hit.join(F.broadcast(members), "names")
    else:
        hit = stored(hit, "hits")
        often = hit.groupBy("names").agg(F.ceil(F.count("*") / HITS).cast("int").alias("shares")).filter("shares > 1")
        often = F.broadcast(stored(often, "often"))
        share = F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))).cast("int")
        dealt = members.join(often, "names", "left").select("names", "targets", F.explode(F.expr("sequence(0, coalesce(shares, 1) - 1)")).alias("share"))
        out = hit.join(often, "names", "left").select("id", "names", share.alias("share")).join(dealt, ["names", "share"])
    return out.select("id.id", "id.doc", F.explode("targets").alias("target")).filter("doc <> target")


def citations(r: DataFrame, ids: DataFrame | None = None, chain: DataFrame | None = None) -> DataFrame:
    """(id, printed, line): document, page of the file, printed page if the page prints one, the chain of headings (cite, else text) and the id."""
    mine = r if ids is None else r.join(ids.select("id").distinct(), "id", "left_semi")
    above = chain if chain is not None else ancestry(r, ids=mine.select("id"))
    name = F.when(F.col("cite") != "", F.col("cite")).otherwise(F.col("text"))
    heads = above.join(r.select(F.col("id").alias("ancestor_id"), name.alias("name")), "ancestor_id")
    heads = heads.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("distance", "name")), asc=False), lambda x: x["name"]), " > ").alias("above"))
    out = mine.select("id", "doc", "page").join(heads, "id", "left").join(printed_pages(r), ["doc", "page"], "left")
    shown = F.when(F.col("printed").isNotNull(), F.concat(F.lit("printed "), F.col("printed")))
    return out.select("id", "printed", F.concat_ws(", ", F.col("doc"), F.concat(F.lit("p. "), F.col("page")), shown, F.when(F.col("above") != "", F.col("above")), F.col("id")).alias("line"))


def backfill(r: DataFrame) -> DataFrame:
    """(id, cite, suggestion): headings that are nothing but their cite, with the longest text of the same document under it. A suggestion only."""
    named = r.filter("cite <> '' AND length(text) > length(cite) + 1").groupBy("doc", "cite").agg(F.max_by("text", F.struct(F.length("text"), -F.col("seq"))).alias("suggestion"))
    bare = r.filter("label = 'section_header' AND cite <> '' AND length(text) <= length(cite) + 1")
    return bare.join(named, ["doc", "cite"]).select("id", "cite", "suggestion")


def variant_pattern(term: str) -> str:
    """A pattern of one slot that also takes what optical readers confuse; stored texts are never rewritten."""
    out = []
    for c in term:
        here = "\\" + c if ord(c) < 128 and not c.isalnum() else c
        out.append(f"[{c}{VARIANTS[c]}]" if c in VARIANTS else here)
    return r"(?U)\b" + "".join(out)


def variant_hits(r: DataFrame, terms: list[str]) -> DataFrame:
    """(id, terms): how many of the terms, variants included, each record has; records without one are left out."""
    hits = [F.col("norm").rlike(variant_pattern(t)).cast("int") for t in terms]
    return r.select("id", reduce(lambda a, b: a + b, hits).alias("terms")).filter("terms > 0")


def routed_hits(routes: DataFrame, sections: DataFrame, phrase: str) -> DataFrame:
    """(ref, hits, routed): sections whose bodies hold a phrase, by exact search over all, and whether the index led there.

    routes: ref, line (an index line); sections: ref, text. Every word of the phrase must stand in a line for it to lead to its section.
    """
    needles = phrase.lower().split()
    led = reduce(lambda a, b: a & b, (F.lower("line").contains(n) for n in needles), F.lit(True))
    routed = routes.filter(led).select("ref").distinct().withColumn("routed", F.lit(True))
    hit = sections.filter(F.lower("text").contains(phrase.lower())).groupBy("ref").agg(F.count("*").alias("hits"))
    return hit.join(routed, "ref", "left").select("ref", "hits", F.coalesce("routed", F.lit(False)).alias("routed"))


def index_lines(terms: DataFrame, heads: DataFrame) -> DataFrame:
    """(ref, line): of each section its reference, the start of its title and its terms by weight. terms: section_id, term, rank; heads: section_id, ref, title."""
    top = terms.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("terms"))
    return heads.join(top, "section_id").select("ref", F.concat_ws(" | ", "ref", F.substring("title", 1, 70), "terms").alias("line"))


def write_index(lines: DataFrame, path: str) -> None:
    """Index lines as text, one file for each range of references."""
    lines.repartitionByRange("ref").sortWithinPartitions("ref").select("line").write.mode("overwrite").text(path)


def slot_ranks(r: DataFrame, slots: list[list[str]]) -> DataFrame:
    """(doc, section, slots, hits): sections under the nearest heading before, by distinct slots, then hits. A slot is a list of patterns, any of which hits."""
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("label") == "section_header", F.struct("id", "text", "page")), ignorenulls=True).over(w)
    text = strip_accents(F.lower("text"))
    flags = [reduce(lambda a, b: a | b, (text.rlike("(?U)" + p) for p in slot)) for slot in slots]
    rows = r.withColumn("head", head).select("doc", F.coalesce("head.id", F.lit("")).alias("section"), *(f.cast("int").alias(f"f{i}") for i, f in enumerate(flags)))
    cols = [F.col(f"f{i}") for i in range(len(slots))]
    got = rows.groupBy("doc", "section").agg(reduce(lambda a, b: a + b, (F.max(c) for c in cols)).alias("slots"), F.sum(reduce(lambda a, b: a + b, cols)).alias("hits"))
    return got.filter("hits > 0").orderBy(F.desc("slots"), F.desc("hits"))


def prefix_chains(headings: DataFrame) -> DataFrame:
    """(id, chain) of headings (id, doc, seq, text): the texts of the headings whose printed cites are prefixes of their own, then their own."""
    cite = F.regexp_replace(F.regexp_extract("text", CITE_PREFIX, 1), r"\.+$", "")
    h = headings.withColumn("cite", cite)
    first = h.filter("cite <> ''").groupBy("doc", "cite").agg(F.min_by("text", "seq").alias("above"))
    parts = F.split("cite", r"\.")
    up = h.filter("cite <> ''").select("id", "doc", F.explode_outer(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, 1, i), ".").alias("cite"))))).alias("p")).filter("p IS NOT NULL")
    up = up.select("id", "doc", "p.i", "p.cite").join(first, ["doc", "cite"]).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "above"))), lambda x: x["above"]).alias("chain"))
    none = F.array().cast("array<string>")
    return h.join(up, "id", "left").select("id", F.array_append(F.coalesce("chain", none), F.col("text")).alias("chain"))


def crossings(r: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(head, child): children that stand past a heading that doesn't belong to their own: their section ran on into the next one.

    Records are numbered by the hierarchy (labels: id, pre, last). The headings between a heading and its child all stand under it if the least and
    the greatest of their numbers do, so no pairs of headings are made.
    """
    labels = stored(labels if labels is not None else order_labels(r), "labels")
    heading = F.when(F.col("label") == "section_header", 1).otherwise(0)
    lined = ranked(r.select("doc", "seq", "id", "parent_id", "label"), "doc", "seq", "id", name="n", kind="long")
    heads = ranked(lined.filter("label = 'section_header'").select("doc", "n", "id"), "n", name="h", kind="long")
    heads = stored(heads.join(labels, "id").select("doc", "n", "h", F.col("id").alias("head"), "pre", "last"), "heads")
    # the last heading before a record, by ranges of one sort: none is carried further than to the next range
    before = preceding(lined.withColumn("given", heading), "n", "given")
    kids = lined.filter("parent_id <> ''").select("doc", "n", F.col("id").alias("child"), F.col("parent_id").alias("head")).join(before, "n")
    mine = kids.join(heads.select("head", F.col("n").alias("at"), F.col("h").alias("own"), "pre", "last", F.col("doc").alias("there")), "head").filter("n > at AND doc = there")
    asked = mine.select("head", "child", "pre", "last", (F.col("own") + 1).alias("first"), F.col("upto").alias("upto"))
    found = extremes(heads, "doc", "h", "pre", asked)
    return found.filter("least <= pre OR most > last").select("head", "child")


def text_layer(pages: DataFrame, sample: int = 40, sparse: int = 100) -> DataFrame:
    """(doc, pages, sampled, median_chars, sparse_fraction) of pages (doc, page, chars): of at most `sample` evenly spaced pages of each document."""
    n = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    at = F.when(F.col("pages") <= sample, F.sequence(F.lit(0), F.greatest(F.col("pages") - 1, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(sample - 1).cast("long")), lambda i: F.floor(i * (F.col("pages") - 1) / (sample - 1))))
    want = n.select("doc", "pages", F.explode_outer(at).alias("k"))
    rows = pages.withColumn("k", (F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1).cast("long"))
    got = want.join(rows, ["doc", "k"])
    return got.groupBy("doc", "pages").agg(F.count("*").alias("sampled"), F.median("chars").alias("median_chars"), F.round(F.avg((F.col("chars") < sparse).cast("double")), 3).alias("sparse_fraction"))


def needs_ocr(layer: DataFrame, fraction: float = 0.5) -> DataFrame:
    return layer.filter(F.col("sparse_fraction") >= fraction).select("doc")


def share_text(part: Column, whole: Column) -> Column:
    """A share in percent, one place; 0.0% of nothing."""
    return F.format_string("%.1f%%", F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)))


def page_selection(r: DataFrame, pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The records of the selected pages (doc, page) and all their ancestors; labels: the numbers that `order.order_labels` gives."""
    kept = r.join(pages.select("doc", "page").distinct(), ["doc", "page"], "left_semi").select("id")
    up = with_ancestors(labels if labels is not None else order_labels(r), kept)
    return r.join(kept.unionByName(up).distinct(), "id", "left_semi")


def shapes(r: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """(shape, n): what a corpus of examples must hold at least once, counted."""
    above = chain if chain is not None else ancestry(r)
    deep = above.groupBy("id").agg(F.max("distance").alias("d")).agg(F.count_if(F.col("d") >= 5).alias("n"))
    label = lambda x: F.count_if(F.col("label") == x).alias(x)
    flat = r.agg(
        F.count_distinct("doc").alias("documents"), F.count_if(F.col("id").contains("~")).alias("numbered id"), F.count_if(F.col("cite") == "").alias("no cite"), F.count_if(F.col("id").contains(":§")).alias("positional id"),
        F.count_if(F.col("text").contains('"')).alias("quoted text"), *map(label, ("table", "caption", "picture", "formula", "footnote")), F.count_if(F.col("text").contains("m²") & F.col("norm").contains("m2")).alias("folded unit"),
    )
    out = flat.select(F.explode(F.array(*(F.struct(F.lit(c).alias("shape"), F.col(f"`{c}`").alias("n")) for c in flat.columns))).alias("x")).select("x.*")
    twice = r.filter("cite <> ''").groupBy("doc", "cite").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    earlier = r.alias("c").join(r.alias("p"), F.col("c.parent_id") == F.col("p.id")).agg(F.count_if(F.col("c.page") != F.col("p.page")).alias("n"))
    for name, one in (("deep chain", deep), ("repeated cite", twice), ("parent on another page", earlier)):
        out = out.unionByName(one.select(F.lit(name).alias("shape"), "n"))
    return out


def drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """(side, and the columns): rows that only one of a stored table and its derivation anew has, repeats counted."""
    cols = stored.columns
    return stored.exceptAll(derived.select(cols)).withColumn("side", F.lit("stored")).unionByName(derived.select(cols).exceptAll(stored).withColumn("side", F.lit("derived")))


def probe_norm(text: Column) -> Column:
    """Lower-case, without marks, white space as one space: what prototypes search. No hyphens, subscripts or units are touched."""
    return strip_accents(collapse(F.lower(text)))
