"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 of low quality, 2 good. P(grade <= k) = sigmoid(threshold_k - w.x)
with one weight vector for all thresholds and increasing thresholds. x holds hashed
words of the whole text (damped counts) and the shares of word shapes.

Fitted by Adam on at most SAMPLE different rows of labelled texts, of the ids with the lowest hashes;
all texts are scored. Features are screened first: a weight is learned where a feature is
in LEAST_TEXTS texts and its share of low grades is LEAST_Z standard errors off chance,
so that words of single documents are not learned by heart. A text is kept while its
probability of at least grade 2 is not under KEEP.

Edge cases: null or empty text has no features and gets the intercept's grade; without
labels every grade is 2; labels of unknown documents are ignored; of several labels of a
document the lowest grade counts; repeated rows repeat, but are fitted once; of an id's different texts, all are fitted up
to SAMPLE in all; a null
doc_id is scored but not fitted; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from turnlake.llm.common import bounded_batches, materialize

BITS = 18
SAMPLE = 8000
GRADES = 3
EPOCHS = 150
LEAST_TEXTS, LEAST_Z = 4, 4.0
KEEP = 0.35
_CACHE = 500_000
_MARKS = b"#*$%&|<>!"


class _Features(dict):
    """word bytes -> (hashed word, hashed shape)."""

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> tuple[int, int]:
        low = word.lower().strip(b".,;:!?()\"'")
        mask = (1 << BITS) - 1
        shape = b"~" + bytes(sorted(set(c for c in word if c in _MARKS))) + (b"U" if word.isupper() and len(word) > 1 else b"") + (b"9" if any(48 <= c < 58 for c in word) else b"") + str(min(len(word), 12)).encode()
        f = (self.hash(low) & mask, self.hash(shape) & mask)
        if len(self) < _CACHE:
            self[word] = f
        return f


@functools.cache
def _features() -> _Features:
    return _Features()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: damped word counts and shares of shapes."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    get = _features().__getitem__
    pairs = Counter(map(get, words))
    word: Counter = Counter()
    shape: Counter = Counter()
    for (w, s), n in pairs.items():
        word[w] += n
        shape[s] += n
    v = 1 + np.log(np.fromiter(word.values(), np.float32, len(word)))
    u = np.fromiter(shape.values(), np.float32, len(shape)) / len(words)
    return np.fromiter([*word, *shape], np.int32, len(word) + len(shape)), np.concatenate([v, 6 * u])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def screened(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> np.ndarray:
    """Which features tell low grades from others beyond chance."""
    size = 1 << BITS
    idx, of = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n = np.bincount(idx, minlength=size)
    keep = np.zeros(size, bool)
    for k in range(GRADES - 1):
        p = (grades <= k).mean()
        low = np.bincount(idx, weights=(grades <= k)[of], minlength=size)
        z = (low - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
        keep |= (n >= LEAST_TEXTS) & (np.abs(z) >= LEAST_Z) & (0 < p < 1)
    return keep


def loss_and_gradients(w: np.ndarray, t: np.ndarray, idx: np.ndarray, val: np.ndarray, of: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades and its gradients by the weights and by t:
    the first threshold and the log of the gap to the second. Entry e of the texts' features
    has index idx[e], value val[e] and belongs to text of[e]."""
    n = len(grades)
    score = np.bincount(of, weights=w[idx] * val, minlength=n)
    th = np.array([t[0], t[0] + np.exp(t[1])])
    up = np.where(grades < GRADES - 1, _sigmoid(th[np.minimum(grades, 1)] - score), 1.0)
    lo = np.where(grades > 0, _sigmoid(th[np.maximum(grades - 1, 0)] - score), 0.0)
    p = np.maximum(up - lo, 1e-9)
    du, dl = up * (1 - up) / p, lo * (1 - lo) / p
    gw = np.bincount(idx, weights=(du - dl)[of] * val, minlength=len(w)) / n
    d0 = -((grades == 0) * du).sum() / n + ((grades == 1) * dl).sum() / n
    d1 = -((grades == 1) * du).sum() / n + ((grades == 2) * dl).sum() / n
    return float(-np.log(p).mean()), gw, np.array([d0 + d1, d1 * np.exp(t[1])])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the likelihood of the grades, with a little weight decay."""
    keep = screened(rows, grades)
    rows = [(i[keep[i]], v[keep[i]]) for i, v in rows]
    idx = np.concatenate([r[0] for r in rows]).astype(np.int64)
    val = np.concatenate([r[1] for r in rows]).astype(np.float64)
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n, size = len(rows), 1 << BITS
    w = np.zeros(size)
    share = [max(0.5, (grades <= k).sum()) / (n + 1) for k in range(GRADES - 1)]
    logit = [np.log(p / (1 - p)) for p in share]
    t = np.array([logit[0], np.log(max(0.1, logit[1] - logit[0]))])
    m1, m2, k1, k2 = np.zeros(size), np.zeros(size), np.zeros(2), np.zeros(2)
    for step in range(1, epochs + 1):
        _, gw, gt = loss_and_gradients(w, t, idx, val, of, grades)
        for x, grad, a, b in ((w, gw + 1e-5 * w, m1, m2), (t, gt, k1, k2)):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            x -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(w.astype(np.float32), np.array([t[0], t[0] + np.exp(t[1])]))


def grade_of(quality, toxic) -> F.Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) | (toxic == 0), 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on the sample labelled documents with the lowest hashes."""
    graded = labels.where("doc_id is not null").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null")
    h = F.xxhash64("doc_id", F.lit("quality"))
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade"))  # of several ratings the lowest
    some = materialize(graded.orderBy(h, "doc_id").limit(sample))  # the bound: SAMPLE rows of two numbers
    bounded_batches(docs.sparkSession)

    def run(text: pa.Array) -> pa.Array:
        rows = [features(x.as_py()) for x in text]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["i", "v"])

    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("doc_id", "text", F.lit("row")))
    # an id may have many rows: different ones are fitted once, and the bound holds for them too
    kept = materialize(joined.select("h").distinct().orderBy("h").limit(sample))
    texts = joined.join(F.broadcast(kept), "h").groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("grade").alias("grade"), F.first("text").alias("text"))
    got = materialize(texts.select("doc_id", "h", "grade", arrow_udf(run, "struct<i: array<int>, v: array<float>>")("text").alias("f"))).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.h))
    return fit([(np.array(r.f.i, np.int32), np.array(r.f.v, np.float32)) for r in got], np.array([r.grade for r in got]))


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, expected_grade, p_not_toxic, p_good, kept."""
    model = train(docs, labels)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 4 << BITS bytes
    bounded_batches(spark)

    def run(text: pa.Array) -> pa.Array:
        m = shared.value
        one = np.ones(len(text))
        if m is None:
            p1 = p2 = one
        else:
            score = np.empty(len(text))
            for k, x in enumerate(text):
                i, v = features(x.as_py())
                score[k] = m.weights[i] @ v
            p1, p2 = (1 - _sigmoid(th - score) for th in m.thresholds)
        return pa.StructArray.from_arrays([pa.array(p1 + p2), pa.array(p1), pa.array(p2)], ["e", "p1", "p2"])

    f = arrow_udf(run, "struct<e: double, p1: double, p2: double>")("text")
    out = docs.select("doc_id", f.alias("f"))
    return out.select("doc_id", F.col("f.e").alias("expected_grade"), F.col("f.p1").alias("p_not_toxic"), F.col("f.p2").alias("p_good"), (F.col("f.p2") >= KEEP).alias("kept"))
