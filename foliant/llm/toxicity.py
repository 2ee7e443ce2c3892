"""Toxic passages by maximum-scoring segment search.

Model: for each token, the log-odds of meeting it in a toxic against a clean labelled document, both
counts smoothed by a Dirichlet prior of `PRIOR` pseudo-documents split as the classes are. Most tokens are as
frequent in both classes, and rare ones differ by chance: the smoothed odds count with the probability that a token's counts
come from odds of its own, the rest are those of the classes (a mixture whose shares are fitted). So every token of
the sample scores by its log-odds, toxic or clean, any other by the prior's, which is 0. Where clean tokens would
cost less than `DRIFT` on average, all scores are lowered alike until they do, for the statistics
need a negative mean. A linear scan (Ruzzo and Tompa, 1999) finds every maximal scoring segment of a text. Under clean text, segment scores follow an extreme-value law
(Karlin and Altschul, 1990): with lambda solved from the clean token frequencies, a text of n tokens has
K n exp(-lambda S) segments of score S or more. K is fitted to the best segments of the clean texts of the sample where it counts, in their tail: the
`TAIL` quantile of the Gumbel law. The segments of a text are joined by the sum statistic of
the r best (1993), for the best r. A logistic curve over that evidence, fitted on labelled rows, gives the score.
What is fitted to sample documents sees each of them by the counts of all others: a token of one document alone tells nothing of it.

Fitting reads a bounded sample: the `SAMPLE` labelled rows, outside the held-out fold, whose ids have the
smallest hashes. Scoring reads every whole text, row by row.

Edge cases: null and empty texts have no segments and get the score of zero evidence; a null doc_id is
never in the sample or held out; without labels of both classes the score is 0; repeated rows give
repeated rows, empty tables empty ones; other columns pass through, and the new ones replace
input columns of the same names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_rows, stored, tidy

SAMPLE = 20_000
PRIOR, DRIFT, TAIL = 1.0, 0.5, 0.95
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
_TOKEN = re.compile(r"\w+")
PASSAGE = "array<struct<first:int,last:int,score:double,expect:double>>"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Table:
    """In how many toxic and clean documents of the sample each token is, by sorted token hashes."""

    keys: np.ndarray
    y1: np.ndarray
    y0: np.ndarray
    toxic: float  # share of toxic documents in the sample
    marked: float = 0.5  # share of the tokens that tell the classes apart
    shift: float = 0.0

    def __post_init__(self):
        """ln of rising factorials of the prior's counts; the marked share by expectation and maximisation."""
        grown = lambda a: np.append(0.0, np.cumsum(np.log(np.arange(int(np.max(self.y1 + self.y0, initial=0)) + 1) + a)))
        self.rise = grown(PRIOR * self.toxic), grown(PRIOR * (1 - self.toxic)), grown(PRIOR)
        for _ in range(30):
            self.marked = float(np.clip(np.mean(self.tells(self.y1, self.y0)), 1e-4, 1 - 1e-4)) if len(self.keys) else 0.5

    def tells(self, y1: np.ndarray, y0: np.ndarray) -> np.ndarray:
        """Probability that tokens of these counts have odds of their own, not those of the sample."""
        more = self.rise[0][y1] + self.rise[1][y0] - self.rise[2][y1 + y0] - y1 * math.log(self.toxic) - y0 * math.log(1 - self.toxic)
        return 1 / (1 + (1 / self.marked - 1) * np.exp(-np.clip(more, -500, 500)))

    def odds(self, y1: np.ndarray, y0: np.ndarray, without: int | None = None) -> np.ndarray:
        """Smoothed log-odds from counts; without: the class of a document that isn't to count."""
        if without is not None:
            y1, y0 = (np.maximum(y1 - 1, 0), y0) if without else (y1, np.maximum(y0 - 1, 0))
        q = self.toxic + self.tells(y1, y0) * ((y1 + PRIOR * self.toxic) / (y1 + y0 + PRIOR) - self.toxic)
        return np.log(q / self.toxic) - np.log((1 - q) / (1 - self.toxic))

    def weights(self, words: list[str], without: int | None = None) -> dict[str, float]:
        """Scores of those words that the sample has."""
        some = list(set(words))
        if not some or not len(self.keys):
            return {}
        sought = hashes(some)
        at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[at] == sought)
        at = at[there]
        return dict(zip([some[i] for i in there.tolist()], (self.odds(self.y1[at], self.y0[at], without) - self.shift).tolist(), strict=True))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    bias: float = -math.inf
    unseen: float = -DRIFT  # of tokens without a weight
    table: Table | None = None  # the weights of a fitted model

    def segments(self, words: list[str], weights: dict[str, float] | None = None) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first, last, score), in order, in linear time."""
        if weights is None:
            weights = self.table.weights(words) if self.table else self.weights
        get, unseen = weights.get, self.unseen
        stack: list[list] = []  # first, last, sum before, sum after, index of the last one with a smaller sum before
        total = 0.0
        for i, w in enumerate(words):
            s = get(w, unseen)
            if s <= 0:
                total += s
                continue
            new = [i, i, total, total + s, -1]
            total += s
            while True:
                j = len(stack) - 1
                while j >= 0 and stack[j][2] >= new[2]:
                    j = stack[j][4]
                if j < 0 or stack[j][3] >= new[3]:
                    new[4] = j
                    stack.append(new)
                    break
                new[0], new[2] = stack[j][0], stack[j][2]
                del stack[j:]
        return [(a, b, y - x) for a, b, x, y, _ in stack]

    def evidence(self, scores: list[float], n: int) -> float:
        """-ln of the probability of the best r segments under clean text, for the best r (0: none)."""
        best, x = 0.0, 0.0
        norm = math.log(self.k * n) if n else 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            if (more := self.lam * s - max(norm, 0.0)) <= 0:
                break
            x += more
            ln_p = -x + (r - 1) * math.log(x) - lgamma(r + 1) - lgamma(r) + r * math.log(2)
            best = max(best, -ln_p)
        return best

    def score(self, evidence: float) -> float:
        if self.bias == -math.inf:
            return 0.0
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * math.log1p(evidence) + self.bias))))


def sample_of(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(text, toxic) of the bounded sample; distinct texts, so that copies don't vote twice."""
    rows = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    some = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id").filter("text IS NOT NULL")
    return stored(some.groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("key"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    sample = sample_of(docs, labels, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, all_of = (Counter(), Counter()), Counter()
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = tokens(t)
                seen[y].update(set(words))
                if not y:
                    all_of.update(words)
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"token": keys, "y1": [seen[1][k] for k in keys], "y0": [seen[0][k] for k in keys], "n0": [all_of[k] for k in keys]})

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    m1, m0 = sizes.get(1, 0), sizes.get(0, 0)
    if not (m1 and m0):
        return Model()
    counts = stored(sample.mapInArrow(tidy(count), "token string, y1 long, y0 long, n0 long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("y1", "y0", "n0"))), "toxic-counts")
    rows = counts.toArrow()  # bounded by the sample
    y1, y0, n0 = (rows[c].to_numpy() for c in ("y1", "y0", "n0"))
    keys = hashes(rows["token"].to_pylist())
    order = np.argsort(keys)
    table = Table(keys[order], y1[order].astype(np.int32), y0[order].astype(np.int32), m1 / (m1 + m0))
    # lambda: the positive root of E[exp(lambda s)] = 1 over clean tokens, each counted once more than seen
    p = (n0 + 1) / np.sum(n0 + 1)
    s = np.where(y0 > 0, table.odds(y1, y0, 0), table.odds(y1, y0))
    table.shift = max(0.0, float(p @ s) + DRIFT)
    s = s - table.shift
    model = Model(unseen=-table.shift, table=table)
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        grown = float(p @ np.exp(np.minimum(mid * s, 600.0)))
        low, high = (mid, high) if grown < 1 else (low, mid)
    model.lam = low

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                words = tokens(t)
                if found := model.segments(words, table.weights(words, 0)):
                    out.append(model.lam * max(x for _, _, x in found) - math.log(len(words)))
            yield pa.RecordBatch.from_pydict({"x": pa.array(out, pa.float64())})

    at = sample.filter("toxic = 0").select("text").mapInArrow(tidy(best), "x double").agg(F.percentile("x", TAIL)).first()[0]  # of the bounded sample
    if at is not None:
        model.k = math.exp(at + math.log(-math.log(TAIL)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = tokens(t)
                e.append(model.evidence([x for _, _, x in model.segments(words, table.weights(words, y))], len(words)))
            yield pa.RecordBatch.from_pydict({"e": pa.array(e, pa.float64()), "toxic": batch.column("toxic")})

    pairs = sample.mapInArrow(tidy(weigh), "e double, toxic int").groupBy(F.round("e", 2).alias("e"), "toxic").count().collect()  # of the bounded sample
    model.slope, model.bias = logistic(np.log1p([r["e"] for r in pairs]), np.array([r["toxic"] for r in pairs], float), np.array([r["count"] for r in pairs], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method with a slight ridge; n: how often each row counts."""
    a = np.stack([np.asarray(x, float), np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (n * (y - q)) - 1e-2 * b
        h = (a * (n * q * (1 - q))[:, None]).T @ a + 1e-2 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, g), -3, 3)
    return float(b[0]), float(b[1])


def assess(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1), toxic (1 if toxicity >= CUT, else 0) and passages (significant segments, as token places)."""
    model = fit(docs, labels, text)
    added = ("toxicity", "toxic", "passages")
    keep = [c for c in docs.columns if c not in added]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.IntegerType()), T.StructField("passages", T._parse_datatype_string(PASSAGE))])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expect", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for t in batch.column(text):
                words = tokens(t.as_py())
                found = model.segments(words)
                scores.append(model.score(model.evidence([x for _, _, x in found], len(words))))
                expect = [(a, b, x, model.k * len(words) * math.exp(-model.lam * x)) for a, b, x in found]
                passages.append([dict(zip(("first", "last", "score", "expect"), p, strict=True)) for p in expect if p[3] <= 0.05])
            out = [*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(out, [*keep, *added])

    return map_rows(docs, run, schema)
