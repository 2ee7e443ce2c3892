"""Where a corpus lives, which documents it has, and the commands over it."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import CODES, doc_code
from .operators import analytics, checks, gates, ingest, search
from .sources import layout, tables, tsv

ROOT_VARIABLE, ANCHOR = "FOLIANT_ROOT", "foliant.root"


class RootError(RuntimeError):
    """No root was given and none was found."""


def root(explicit: str | None = None, start: str | None = None) -> Path:
    """The folder of the corpus: as given, else as the environment says, else the nearest folder upward that has the anchor file."""
    if explicit is not None:
        return Path(explicit).resolve()
    if named := os.environ.get(ROOT_VARIABLE):
        return Path(named).resolve()
    here = Path(start or os.getcwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / ANCHOR).is_file():
            return folder
    raise RootError(f"no {ANCHOR} in or above {here}; give a root or set {ROOT_VARIABLE}")


def registered(spark: SparkSession, documents: list[str]) -> DataFrame:
    """(doc, code) of the listed documents: others are never scanned. Codes that clash are an error, for ids begin with them."""
    rows = spark.createDataFrame([(d,) for d in documents], "doc string").select("doc", doc_code(F.col("doc")).alias("code"))
    if twice := rows.groupBy("code").count().filter("count > 1").first():
        raise ValueError(f"{twice['count']} documents have the code {twice['code']}")
    return rows


def read_documents(spark: SparkSession, folder: str, documents: list[str]) -> DataFrame:
    """Layout items of the listed documents."""
    return layout.items(layout.read_layout(spark, [f"{folder}/{d}.json" for d in documents]))


@dataclass
class Corpus:
    """Records and provenance of a corpus, loaded once; the four operations that answer from them."""

    records: DataFrame
    provenance: DataFrame
    chains: DataFrame | None = field(default=None)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Corpus:
        records, provenance = tsv.load(spark, f"{folder}/corpus.tsv", f"{folder}/corpus.provenance.tsv")
        return cls(records, provenance)

    def search(self, terms: list[str]) -> DataFrame:
        return search.search(self.records, terms, self.chains)

    def get(self, ids: list[str]) -> tuple[DataFrame, DataFrame]:
        return search.get(self.records, ids, self.chains)

    def get_by_cite(self, cite: str, doc: str | None = None) -> DataFrame:
        return search.get_by_cite(self.records, cite, doc, self.chains)

    def get_page(self, doc: str, page: int) -> DataFrame:
        return search.get_page(self.records, self.provenance, doc, page)


#: What callers are told of each operation.
TOOLS = {
    "search": "Sections in which at least two of the given terms occur, best first, with the ids of matching children.",
    "get": "Records by id, in the order asked for, with their ancestors and direct children; unknown ids are listed apart.",
    "get_by_cite": "Every address that bears a printed cite, in reading order.",
    "get_page": "The records of one page in reading order.",
}


def build(spark: SparkSession, folder: str, out: str, documents: list[str]) -> DataFrame:
    """Ingests the listed documents and writes both corpus files; returns the counts of what was dropped and kept."""
    registered(spark, documents)
    read = layout.read_layout(spark, [f"{folder}/{d}.json" for d in documents])
    items, names = layout.items(read), spark.createDataFrame([(d,) for d in documents], "doc string")
    ocr = layout.read_pipeline(spark, folder).join(names, "doc", "left_semi")
    records = ingest.build(items, ocr)
    place = spark.createDataFrame(list(enumerate(documents)), "place long, doc string").select("place", doc_code(F.col("doc")).alias("doc"))
    records = records.join(place, "doc").withColumn("seq", F.col("place") * 10_000_000_000 + F.col("seq")).drop("place")
    tsv.write_corpus(records, ingest.provenance(layout.page_counts(read), ocr), out)
    return ingest.tally(items)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """ingest, check, check-content, evaluate: 0 if all is well, 1 if a gate fails or a set passes too rarely."""
    p = argparse.ArgumentParser(prog="foliant")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="layout files to corpus files")
    one.add_argument("--layouts", default=None)
    one.add_argument("--out", default=None)
    one.add_argument("--docs", nargs="*", default=list(CODES))
    one.add_argument("--stats", action="store_true")
    sub.add_parser("check", help="structure of the corpus").add_argument("--corpus", default=None)
    content = sub.add_parser("check-content", help="symbols and angles that must be there, phantoms and furniture that must not, chains of headings")
    content.add_argument("--corpus", default=None)
    content.add_argument("--doc", required=True)
    content.add_argument("--expect", required=True, help="a quoted table with the columns kind (symbol, angle, phantom, furniture or chain), what (a string; a pattern; a text and its headings, nearest first, parted by |) and least")
    gold = sub.add_parser("evaluate", help="how many of the questions of a gold set were answered rightly, by set")
    gold.add_argument("--questions", required=True)
    gold.add_argument("--answers", required=True)
    gold.add_argument("--results", required=True, help="a quoted table with the columns set, number and passed")
    gold.add_argument("--least", type=float, default=0.0, help="the share of each set that must pass")
    p.add_argument("--root", default=None)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("foliant").getOrCreate()
    if a.command == "ingest":
        base = root(a.root) if None in (a.layouts, a.out) else None
        told = build(spark, a.layouts or f"{base}/layouts", a.out or f"{base}/corpus", a.docs)
        if a.stats:
            for r in told.orderBy("what").collect():  # a row for each kind of item
                print(f"{r['what']}\t{r['n']}")
        return 0
    if a.command == "evaluate":
        asked = tables.gold_set(spark, a.questions, a.answers).select("set", "number")
        passed = tables.read_gold(spark, a.results, ["set", "number", "passed"]).select("set", "number", (F.lower("passed") == "true").alias("passed"))
        low = False
        for r in analytics.pass_rate(asked, passed).orderBy("set").collect():  # a row a set
            print(f"{r['set']}\t{r['passes']}\t{r['attempted']}\t{r['rate']:.3f}")
            low |= r["rate"] < a.least
        return int(low)
    corpus = Corpus.load(spark, a.corpus or f"{root(a.root)}/corpus")
    if a.command == "check":
        failed = checks.failures(corpus.records, corpus.provenance).collect()  # a row for each gate
        lines = [f"{r['gate']}: {r['n']}" for r in failed]
    else:
        want = tables.read_gold(spark, a.expect, ["kind", "what", "least"]).withColumn("least", F.col("least").cast("int"))
        mine = corpus.records.filter(F.col("doc") == a.doc)
        seen = gates.symbol_bands(mine, want.filter("kind = 'symbol'")).unionByName(gates.angle_bands(mine, want.filter("kind = 'angle'")))
        said = {k: [r["what"] for r in want.filter(F.col("kind") == k).select("what").distinct().collect()] for k in ("phantom", "furniture", "chain")}  # a caller's table
        if said["phantom"]:
            seen = seen.unionByName(gates.phantoms(mine, {w: w for w in said["phantom"]}))
        if said["furniture"]:
            seen = seen.unionByName(gates.furniture(mine, said["furniture"]))
        for text in said["chain"]:
            having, *above = (x.strip() for x in text.split("|"))
            wrong = gates.chains(mine, having, above)
            # none at all is a fault as well: what was verified is gone
            seen = seen.unionByName(wrong.agg(F.lit(text).alias("what"), F.count_if(~F.col("ok")).alias("n"), ((F.count("*") > 0) & (F.count_if(~F.col("ok")) == 0)).alias("ok")))
        lines = [f"{r['what']}: {r['n']}" for r in seen.filter("NOT ok").collect()]
        lines += [f"not native: {r['doc']} {r['page_from']}-{r['page_to']}" for r in gates.foreign_sources(corpus.provenance).collect()]
    for line in lines:
        print(line, file=sys.stderr)
    return 1 if lines else 0


if __name__ == "__main__":
    sys.exit(main())
