"""Quality classifier: a factorisation machine over hashed words, word shapes and structure statistics.

The score is the logistic function of  b + <w, x> + 1/2 sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2):  all pairwise
interactions at the cost of one pass over the features. Features come from the whole text: hashed words and hashed word
shapes (letters, digits and marks reduced to classes), both L2-normalised counts, and standardised statistics of its bytes,
words and lines. The only metadata is the text's size; language, source and ids are not read.

Training takes a bounded sample of labelled rows (`max_rows`, those of the smallest hashed ids) and runs Adam on the
driver; features of the sample are made on the executors. Everything else covers all rows.

Defined results: null texts count as empty and are scored like any; rows that repeat get the same score; null ids are
never held out; without labels of both kinds every score is the share of good labels (1 without any); extra columns are
ignored by `score_quality`.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, lean

WORDS, SHAPES, STATS = 1 << 13, 1 << 10, 20
RANK = 8
#: Labelled rows that training takes at most.
MAX_ROWS = 12_000
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_SHAPE = bytes((b, ord("a"), ord("A"), ord("9"), ord("u"), ord(" "))[c] for b, c in enumerate(_CLASS.tolist()))
_CACHE: dict[bytes, tuple[int, int]] = {}


def _slots(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its shape: runs of a class become one letter."""
    got = _CACHE.get(word)
    if got is None:
        if len(_CACHE) > 100_000:
            _CACHE.clear()
        shape = word.translate(_SHAPE)
        short = bytes(c for i, c in enumerate(shape) if not i or c != shape[i - 1])[:12]
        got = zlib.crc32(word.lower()) % WORDS, WORDS + zlib.crc32(short) % SHAPES
        if len(word) <= 40:
            _CACHE[word] = got
    return got


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indexes, values, statistics) of a text."""
    raw = (text or "").encode()
    n = len(raw)
    stats = np.zeros(STATS)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32), stats
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, weights=byte, minlength=6) / n
    p = byte[byte > 0] / n
    words = raw.split()
    m = max(len(words), 1)
    counts = Counter(words)
    again = sum(map(operator.eq, words, words[1:])) if len(words) > 1 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = [byte[ord(c)] / n for c in "!|*$&#%?"]
    stats[:] = [
        np.log1p(n), np.log1p(len(words)), n / m, classes[0], classes[2], classes[3], classes[4], len(counts) / m,
        max(counts.values(), default=0) / m, again / m, len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)),
        float(-(p * np.log2(p)).sum()), *marks[:7],
    ]
    sums: dict[int, float] = {}
    for word, k in counts.items():
        a, b = _slots(word)
        sums[a] = sums.get(a, 0) + k
        sums[b] = sums.get(b, 0) + k
    index = np.fromiter(sums, np.uint16, len(sums))
    value = np.fromiter(sums.values(), np.float32, len(sums))
    for part in (index < WORDS, index >= WORDS):
        value[part] /= max(float(np.sqrt((value[part] ** 2).sum())), 1e-9)
    return index, value, stats


class FactorisationMachine:
    """b, w and V over words, shapes and standardised statistics."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.bias, self.w, self.v, self.mean, self.scale = bias, w, v, mean, scale

    def score(self, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
        dense = np.clip((stats - self.mean) / self.scale, -4, 4)
        base = WORDS + SHAPES
        v, u = self.v[index], self.v[base:]
        sums = value @ v + dense @ u
        squares = (value**2) @ (v**2) + (dense**2) @ (u**2)
        z = self.bias + value @ self.w[index] + dense @ self.w[base:] + 0.5 * float((sums**2 - squares).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    """Adam on the logistic loss, batches of `batch` rows; deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    base, width = WORDS + SHAPES, WORDS + SHAPES + STATS
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    dense = np.clip((stats - mean) / scale, -4, 4)
    share = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    p = np.zeros((width, 1 + RANK))
    p[:, 1:] = rng.normal(0, 0.01, (width, RANK))
    bias, m1, m2, b1, b2 = np.log(share / (1 - share)), np.zeros_like(p), np.zeros_like(p), 0.0, 0.0
    step, tail = 0, np.arange(base, width)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            n = np.array([len(rows[i][0]) + STATS for i in own])
            index = np.concatenate([np.concatenate([rows[i][0].astype(np.int64), tail]) for i in own])
            value = np.concatenate([np.concatenate([rows[i][1], dense[i]]) for i in own])
            first = np.cumsum(n) - n
            got = p[index]
            linear = np.add.reduceat(value * got[:, 0], first)
            vx = value[:, None] * got[:, 1:]
            sums = np.add.reduceat(vx, first, axis=0)
            z = bias + linear + 0.5 * (sums**2 - np.add.reduceat(vx**2, first, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]) / len(own)
            e = np.repeat(error, n) * value
            grad = np.empty_like(got)
            grad[:, 0] = e
            grad[:, 1:] = e[:, None] * (np.repeat(sums, n, axis=0) - vx)
            full = np.empty_like(p)
            for f in range(1 + RANK):
                full[:, f] = np.bincount(index, weights=grad[:, f], minlength=width)
            full += decay * p
            step += 1
            m1 = 0.9 * m1 + 0.1 * full
            m2 = 0.999 * m2 + 0.001 * full**2
            p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            g = float(error.sum())
            b1, b2 = 0.9 * b1 + 0.1 * g, 0.999 * b2 + 0.001 * g * g
            bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-8)
        rate *= 0.8
    return FactorisationMachine(float(bias), p[:, 0].astype(np.float32), p[:, 1:].astype(np.float32), mean, scale)


def _sample_features(batches):
    for batch in batches:
        out = {"doc_id": [], "label": [], "index": [], "value": [], "stats": []}
        for doc, text, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            i, v, s = features(text.as_py())
            for k, x in zip(out, (doc, label, i.tobytes(), v.astype("<f4").tobytes(), s.astype("<f8").tobytes())):
                out[k].append(x)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def held_out(column: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Trains on at most max_rows labelled documents outside the held-out third.

    Rows that repeat an id are all learnt from if they stay within max_rows; else one text of each id is.
    """
    arrow_batches(docs.sparkSession)
    known = labels.where(~held_out()).where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("__id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("__label"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    some = docs.join(F.broadcast(known), docs["doc_id"].cast("long") == F.col("__id"))  # broadcast of max_rows ids at most
    kind = "doc_id long, label int, index binary, value binary, stats binary"
    table = some.select("__id", "text", "__label").mapInArrow(lean(_sample_features), kind).limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:  # ids that repeat: one text of each, that of the least hash
        one = some.groupBy("__id").agg(F.min_by(F.struct("text", "__label"), F.xxhash64("text")).alias("row")).select("__id", "row.*")
        table = one.mapInArrow(lean(_sample_features), kind).toArrow()
    table = table.to_pylist()
    table.sort(key=lambda r: (r["doc_id"], r["index"], r["value"]))
    rows = [(np.frombuffer(r["index"], np.uint16), np.frombuffer(r["value"], "<f4"), np.frombuffer(r["stats"], "<f8")) for r in table]
    y = np.array([r["label"] for r in table], float)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1 - 1e-6
        width = WORDS + SHAPES + STATS
        return FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), np.zeros(STATS), np.ones(STATS))
    return train(rows, y)


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches):
        for batch in batches:
            scores = [model.score(*features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double")


def keep_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that score at least `threshold`."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.score(*features(t.as_py())) >= threshold for t in batch.column("text")], pa.bool_()))

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)
