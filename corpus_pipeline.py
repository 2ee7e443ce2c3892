"""Five stages from raw documents to encoded ones; each takes what its predecessor kept.

toxicity, quality, near duplicates and decontamination return the columns of their input, fewer rows; the last stage adds the
token ids and the decoded text. Every stage decides by a row's own text: rows that share a doc_id, or have none, are told apart by
what they hold. Of a group of near duplicates one row stays, the one with the least doc_id (rows without one come last; of rows with
that id, the one with the least text hash). Rows whose text has no words are no near duplicates; the
quality stage has removed them before. Empty tables pass through all stages, and columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import pieces, quality, setjoin, toxicity, winnow
from foliant.llm.common import named, shared_path, stored, table

#: Rows of an id and a hash that may be broadcast.
SMALL = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic."""
    names = _named(docs)
    out = toxicity.assess(names, table(spark, sf_dir, "labels")).filter("toxic = 0")
    return _back(out, docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or score as unlike the trusted ones."""
    out = quality.assess(_named(docs), table(spark, sf_dir, "labels")).filter("kept")
    return _back(out, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by similarity: the row with the least id (rows without one come last), of these the least text hash."""
    rows = stored(setjoin.join(docs).filter("cluster IS NOT NULL").select("doc", "same", "cluster"), "clusters")
    # a row is told by its id and text; equal rows are counted here and merged at the end
    kinds = rows.groupBy("cluster", "doc", "same").agg(F.count("*").alias("rows"))
    first = kinds.groupBy("cluster").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "same", "rows")).alias("first"), F.sum("rows").alias("all")).filter("all > 1")
    kinds = kinds.join(first.select("cluster", "first"), "cluster")
    stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("same") == F.col("first.same"))
    marked = stored(kinds.select(F.col("doc").alias("__p_doc"), F.col("same").alias("__p_same"), stays.alias("__p_stays")).filter("NOT __p_stays OR first.rows > 1"), "marked")
    mine = named(docs, "doc_id").eqNullSafe(F.col("__p_doc")) & (F.xxhash64(named(docs, "text")) == F.col("__p_same"))

    def with_few(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows

    left = docs.join(with_few(marked), mine, "left_anti")
    several = marked.filter("__p_stays")
    if not several.limit(1).count():
        return left
    return left.unionByName(docs.join(with_few(several), mine, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return winnow.screen(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids and decoded."""
    from foliant.llm.queries import piece_model

    return pieces.round_trip(docs, piece_model())


def _named(docs: DataFrame) -> DataFrame:
    """The columns in one struct beside the two that the operators read: no name of theirs can clash."""
    return docs.select(F.struct(*(named(docs, c) for c in docs.columns)).alias("__p_row"), "doc_id", "text")


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col("__p_row")[c].alias(c) for c in docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode),
]

#: Toxicity, components and encoding have no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder, which the next stage reads."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
