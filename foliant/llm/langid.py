"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions (`HIDDEN` units each), labels every position with language
probabilities, and a document's probabilities are the means over its positions. It is trained in numpy by
backpropagation through time, with Adam, on a bounded sample: the `SAMPLE` labelled documents whose
ids have the smallest hashes outside the held-out fold. Their whole texts are cut into windows of `WINDOW` bytes, as prediction cuts them,
and training draws from all of these: at most one window for each place in its batches, by hash. Classes weigh alike.
Everything random comes from a fixed seed.

Prediction reads every whole text, cut into stretches of `STRETCH` bytes that are labelled side by side; the state starts anew
in each. Both directions are rows of the same arrays, so a time step is a few operations for thousands of stretches.

Edge cases: a null text and one without letters get `und` and score 0, as do all texts if there is
nothing to learn from; a null lang isn't learned; a null doc_id is neither learned from nor held out; repeated rows give
repeated rows, empty tables empty ones; other columns pass through, and the new ones replace input columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_rows

FOLDS, HELD_OUT = 3, 1
SAMPLE, WINDOW = 2000, 64
HIDDEN, STRETCH, SIDE_BY_SIDE = 8, 128, 4096
EPOCH_STEPS, BATCH, RATE, SEED = 220, 192, 0.02, 7
_LIKELY = re.compile(r"[^\W\d_]")  # letters and numerals that aren't digits


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter by its category: ½ and ² are none."""
    return bool(text) and any(m[0].isalpha() for m in _LIKELY.finditer(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Network:
    """Rows of table and recur: update, reset and candidate gates, each of the forward and then the backward units."""

    names: list[str]
    table: np.ndarray  # 6 * HIDDEN x 256: input weights of each byte, biases included
    recur: np.ndarray  # 6 * HIDDEN x 2 * HIDDEN, zero between directions
    out: np.ndarray  # languages x 2 * HIDDEN
    bias: np.ndarray  # languages x 1

    def steps(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x, mask: time x stretches. States after each step, time x 2 * HIDDEN x stretches; the backward half is in reading order too."""
        t, b, h = len(x), x.shape[1], HIDDEN
        state = np.zeros((2 * h, b), np.float32)
        states = np.empty((t, 2 * h, b), np.float32)
        saved = []
        rows = np.arange(6 * h).reshape(3, 2, h)
        ahead, back = np.ascontiguousarray(self.table[rows[:, 0].ravel()]), np.ascontiguousarray(self.table[rows[:, 1].ravel()])
        both = np.empty((3, 2, h, b), np.float32)
        live = np.empty((2, 1, b), np.float32)
        for i in range(t):
            both[:, 0] = ahead[:, x[i]].reshape(3, h, b)
            both[:, 1] = back[:, x[t - 1 - i]].reshape(3, h, b)
            a, r = both.reshape(3, 2 * h, b), (self.recur @ state).reshape(3, 2 * h, b)
            gates = _sigmoid(a[:2] + r[:2])
            n = np.tanh(a[2] + gates[1] * r[2])
            new = state - n
            new *= gates[0]
            new += n
            live[0], live[1] = mask[i], mask[t - 1 - i]
            new.reshape(2, h, b)[...] *= live
            if keep:
                saved.append((state, gates[0], gates[1], n, r[2]))
            state = new
            states[i, :h] = state[:h]
            states[t - 1 - i, h:] = state[h:]
        return states, saved

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """languages x time x stretches."""
        t, h, b = states.shape
        z = np.matmul(self.out, states) + self.bias  # time x languages x stretches
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def label(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of the positions of each text, texts x languages."""
        total = np.zeros((len(texts), len(self.names)))
        sizes = np.array([len(t) for t in texts])
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        data = np.frombuffer(b"".join(t + b"\0" * (-len(t) % STRETCH) for t in texts), np.uint8).reshape(-1, STRETCH)
        left = np.full(len(owner), STRETCH)
        left[np.cumsum(pieces)[pieces > 0] - 1] = ((sizes - 1) % STRETCH + 1)[pieces > 0]
        order = np.argsort(-left, kind="stable")
        for s in range(0, len(order), SIDE_BY_SIDE):
            mine = order[s : s + SIDE_BY_SIDE]
            long = int(left[mine].max())
            x = np.ascontiguousarray(data[mine, :long].T)
            mask = (np.arange(long)[:, None] < left[mine]).astype(np.float32)
            p = self.probabilities(self.steps(x, mask)[0])
            p *= mask[:, None]
            np.add.at(total, owner[mine], p.sum(0).T)
        return total / np.maximum(sizes, 1)[:, None]


def train(windows: list[bytes], labels: list[int], names: list[str]) -> Network:
    """Adam over EPOCH_STEPS batches; the loss is the cross-entropy at every position."""
    r, h, k = np.random.default_rng(SEED), HIDDEN, len(names)
    x = np.zeros((WINDOW, len(windows)), np.uint8)
    mask = np.zeros((WINDOW, len(windows)), np.float32)
    for i, w in enumerate(windows):
        x[: len(w), i], mask[: len(w), i] = np.frombuffer(w, np.uint8), 1
    y = np.array(labels)
    weight = (len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1)))[y].astype(np.float32)
    apart = np.tile(np.repeat(np.arange(2), h), 3)[:, None] == np.repeat(np.arange(2), h)[None]
    f = np.float32
    net = Network(names, r.normal(0, 0.4, (6 * h, 256)).astype(f), (r.normal(0, h**-0.5, (6 * h, 2 * h)) * apart).astype(f), r.normal(0, 0.3, (k, 2 * h)).astype(f), np.zeros((k, 1), f))
    net.table[: 2 * h] += 1  # states begin by lasting
    params = [net.table, net.recur, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCH_STEPS + 1):
        pick = r.integers(0, len(windows), BATCH)
        xs, ms = x[:, pick], mask[:, pick]
        grads = _gradients(net, xs, ms, y[pick], weight[pick], apart)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (EPOCH_STEPS + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(f)
    return net


def _gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    t, b, h = len(x), x.shape[1], HIDDEN
    states, saved = net.steps(x, mask, keep=True)
    z = net.probabilities(states)
    z[:, y, np.arange(b)] -= 1
    z *= (mask * weight)[:, None] / max(1.0, float(mask.sum()))
    d_out = np.einsum("tkb,thb->kh", z, states)
    d_bias = z.sum((0, 2))[:, None]
    d_states = np.matmul(net.out.T, z)  # time x units x stretches
    d_recur = np.zeros_like(net.recur)
    d_in = np.empty((t, 3, 2, h, b), np.float32)
    d = np.zeros((2 * h, b), np.float32)
    for i in range(t - 1, -1, -1):
        d[:h] += d_states[i, :h]
        d[h:] += d_states[t - 1 - i, h:]
        d.reshape(2, h, b)[...] *= np.stack([mask[i], mask[t - 1 - i]])[:, None]
        before, u, g, n, rn = saved[i]
        dn = d * (1 - u) * (1 - n * n)
        du = d * (before - n) * u * (1 - u)
        dg = dn * rn * g * (1 - g)
        d_in[i] = np.stack([du, dg, dn]).reshape(3, 2, h, b)
        through = np.concatenate([du, dg, dn * g])
        d_recur += through @ before.T
        d = d * u + net.recur.T @ through
    d_table = np.zeros_like(net.table)
    rows = np.arange(6 * h).reshape(3, 2, h)
    for side, seen in ((0, x.ravel()), (1, x[::-1].ravel())):
        flat = d_in[:, :, side].transpose(1, 2, 0, 3).reshape(3 * h, -1)
        for row, g in zip(rows[:, side].ravel(), flat, strict=True):
            d_table[row] = np.bincount(seen, g, 256)
    return [d_table, d_recur * apart, d_out, d_bias]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id") -> Network | None:
    """Trains on the bounded sample; None without any labelled text."""
    rows = docs.filter(fold(F.col(doc), FOLDS) != HELD_OUT).filter(F.col(lang).isNotNull())
    ids = rows.select(F.col(doc).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # a row for each of SAMPLE ids, however often it is repeated
    got = rows.join(F.broadcast(ids), F.col(doc) == F.col("id")).filter(F.length(text) > 0)
    got = got.groupBy("id").agg(F.min_by(F.struct(F.col(lang).alias("lang"), F.encode(F.col(text), "UTF-8").alias("b")), F.struct(F.xxhash64(doc, text), F.col(lang))).alias("x")).select("id", "x.*")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / WINDOW).cast("int"))
    windows = got.select("id", "lang", F.posexplode(F.transform(starts, lambda k: F.substring("b", k * WINDOW + 1, F.lit(WINDOW)))).alias("k", "w"))
    names = [r["lang"] for r in got.select("lang").distinct().orderBy("lang").collect()]  # languages
    drawn = windows.orderBy(F.xxhash64("id", "k"), "id", "k").select("lang", "w").limit(EPOCH_STEPS * BATCH).collect()
    return train([bytes(r["w"]) for r in drawn], [names.index(r["lang"]) for r in drawn], names) if drawn else None


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and lang_score (its mean probability over the positions)."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = ["und"] * len(batch), [0.0] * len(batch)
            at, held, size = [], [], 0
            column = batch.column(text)
            for i in range(len(batch) + 1):
                if net and held and (i == len(batch) or size > SIDE_BY_SIDE * STRETCH * 4):
                    p = net.label(held)
                    for j, q in zip(at, p, strict=True):
                        k = int(q.argmax())
                        names[j], scores[j] = net.names[k], min(1.0, float(q[k]))
                    at, held, size = [], [], 0
                if i < len(batch) and has_letter(s := column[i].as_py()):
                    at.append(i)
                    held.append(s.encode())
                    size += len(held[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "lang_score"])

    return map_rows(docs, run, schema)
