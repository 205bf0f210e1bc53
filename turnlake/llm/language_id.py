"""Language ID by nearest centroid.

A text is a vector of hashed letter n-grams (1 to 3, words padded by a space), square-root
counts times inverse document frequency, normalised. Each language has a few centroids,
found by spherical k-means among its training vectors; a text gets the language of the
centroid with the highest cosine. It is rejected where its distance exceeds what nearly
all training texts of that centroid have, by a margin that shrinks with the text's length.

The classifier is fitted on at most SAMPLE texts per language, the different rows with the
lowest hash of doc_id and text among those allowed for training; every language is learned, BLOCK of them
at a time. Everything else covers all rows, and whole texts.

Edge cases: null text or text without a letter is ``und`` with score 0, and rejected;
without any training row all texts are ``und``; languages with one text have one centroid;
repeated rows repeat, but are learned once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from turnlake.llm.common import bounded_batches, materialize

BITS = 12
SAMPLE = 600
#: Languages whose sampled vectors are held at once.
BLOCK = 32
CENTROIDS = 3
#: k-means: starts, steps, the least share of a language's texts that a centroid stands for.
RESTARTS, STEPS, LEAST_CLUSTER, SEED = 4, 10, 0.05, 3
#: A centroid's radius: this quantile of its training texts' distances, times SLACK.
RADIUS_QUANTILE, SLACK = 0.99, 1.5
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of a whole text's letter 1-, 2- and 3-grams."""
    out = np.zeros(1 << BITS, np.float32)
    shift = np.uint32(32 - BITS)
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    for at in range(0, max(len(a), 1), 1 << 20):  # bounded work space for any length; blocks overlap by two
        c = a[max(0, at - 2) : at + (1 << 20)]
        c = np.where(c < 0x10000, _letters()[np.minimum(c, 0xFFFF)], c)
        c = np.r_[np.uint32(32), c, np.uint32(32)]
        h = c * np.uint32(0x9E3779B1)
        letter = c != 32
        grams = [h[letter] >> shift]
        h2 = (h[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        grams.append(h2[letter[1:] | letter[:-1]] >> shift)
        h3 = (h2[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        grams.append(h3[letter[1:-1]] >> shift)
        out += np.bincount(np.concatenate(grams), minlength=1 << BITS).astype(np.float32)
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    radii: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the rows, each drawn by its distance from those before it."""
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        far = np.maximum(1 - (x @ c.T).max(axis=1), 0)
        c = np.r_[c, x[[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))]]]
    return c


def clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of at most k clusters of unit rows by spherical k-means: the best of RESTARTS
    by mean cosine, in each of which clusters under LEAST_CLUSTER of the rows are given up."""
    best, rng = (-2.0, None), np.random.default_rng(SEED)
    for _ in range(RESTARTS):
        c = _spread(x, min(k, len(x)), rng)
        for _ in range(STEPS):
            of = (x @ c.T).argmax(axis=1)
            n = np.bincount(of, minlength=len(c))
            good = np.flatnonzero(n >= max(1, LEAST_CLUSTER * len(x)))
            c = np.stack([_unit(x[of == i].mean(axis=0)) for i in (good if len(good) else [n.argmax()])])
        best = max(best, (float((x @ c.T).max(axis=1).mean()), c), key=lambda b: b[0])
    return best[1]


def fit(vectors: np.ndarray, languages: list[str], k: int = CENTROIDS, idf: np.ndarray | None = None) -> Model:
    """vectors: counts of the training texts; idf: of more texts than these, if given."""
    if idf is None:
        idf = _idf(len(vectors), (vectors > 0).sum(axis=0))
    unit = _unit(np.sqrt(vectors) * idf)
    names, cents, radii = [], [], []
    for lang in sorted(set(languages)):
        x = unit[[i for i, v in enumerate(languages) if v == lang]]
        c = clustered(x, k)
        of, far = (x @ c.T).argmax(axis=1), 1 - (x @ c.T).max(axis=1)
        whole = np.quantile(far, RADIUS_QUANTILE)
        names += [lang] * len(c)
        cents.append(c)
        radii += [max(whole, np.quantile(far[of == i], RADIUS_QUANTILE) if (of == i).any() else 0) for i in range(len(c))]
    return Model(idf, names, np.concatenate(cents or [np.zeros((0, 1 << BITS))]).astype(np.float32), np.array(radii))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, cosine and whether it is too far, for whole texts."""
    lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    rows = [i for i, t in enumerate(texts) if has_letter(t)]
    for at in range(0, len(rows) if len(model.languages) else 0, 256):
        some = rows[at : at + 256]
        n = np.stack([counts(texts[i]) for i in some])
        cos = _unit(np.sqrt(n) * model.idf) @ model.centroids.T
        best = cos.argmax(axis=1)
        # short texts are far from any centroid by chance
        margin = SLACK * model.radii[best] + 3.0 / np.sqrt(np.maximum(n.sum(axis=1), 1))
        for i, b, c, m in zip(some, best, cos.max(axis=1), margin, strict=True):
            lang[i], score[i], rejected[i] = model.languages[b], float(min(max(c, 0), 1)), bool(1 - c > m)
    return lang, score, rejected


def _counted(text: pa.Array) -> pa.Array:
    return pa.array([counts(t.as_py() or "").tobytes() for t in text], pa.binary())


def _empty() -> tuple[np.ndarray, list[str]]:
    return np.zeros((0, 1 << BITS), np.float32), []


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows (doc_id, text, lang): per language the sample different rows with the lowest hashes
    of id and text; rows equal in both are learned once, however often they come."""
    bounded_batches(rows.sparkSession)
    rows = rows.where("text is not null and lang is not null").withColumn("h", F.xxhash64(F.lit("lang"), "doc_id", "text"))
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")).collect()}
    if not per:
        return fit(*_empty())
    # a hash limit per language that lets about 1.2 samples of different rows through
    limits = rows.sparkSession.createDataFrame([(k, min(2**32, int(1.2 * sample / max(n, 1) * 2**32) + 1)) for k, n in per.items()], "lang string, most long")
    some = rows.join(F.broadcast(limits), "lang").where("(h & 4294967295) < most").groupBy("lang", "h").agg(F.first("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.expr("h & 4294967295"), "h")  # of about 1.2 samples
    some = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample)
    some, names = materialize(some.select("lang", "r", arrow_udf(_counted, "binary")("text").alias("v"))), sorted(per)

    def block(at: int) -> tuple[np.ndarray, list[str]]:
        """Sampled vectors that are not empty, and their languages: sample x BLOCK are collected at most."""
        got = some.where(F.col("lang").isin(names[at : at + BLOCK])).collect()
        if not got:
            return _empty()
        got.sort(key=lambda r: (r.lang, r.r))
        vectors = np.stack([np.frombuffer(r.v, np.float32) for r in got])
        full = vectors.sum(axis=1) > 0
        return vectors[full], [r.lang for r, f in zip(got, full, strict=True) if f]

    starts = range(0, len(names), BLOCK)
    if len(starts) == 1:
        vectors, langs = block(0)
        return fit(vectors, langs)
    n, df = 0, np.zeros(1 << BITS, np.int64)  # over all blocks, then each is fitted with them
    for at in starts:
        vectors, _ = block(at)
        n, df = n + len(vectors), df + (vectors > 0).sum(axis=0)
    parts = [fit(*block(at), idf=_idf(n, df)) for at in starts]
    return Model(_idf(n, df), [x for p in parts for x in p.languages], np.concatenate([p.centroids for p in parts]), np.concatenate([p.radii for p in parts]))


def identified(model: Model, text: Column) -> Column:
    """struct<lang, score, rejected> of texts."""

    def run(text: pa.Array) -> pa.Array:
        lang, score, rejected = predict(model, text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    return arrow_udf(run, "struct<lang: string, score: double, rejected: boolean>")(text)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows not held out; judge all: doc_id, held_out, lang_pred, score, rejected."""
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", held.alias("held_out"), identified(model, F.col("text")).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, without those that the classifier rejects: no letters, or
    beyond the radius of the nearest centroid."""
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    bounded_batches(docs.sparkSession)
    beside = docs.select(F.struct("*").alias("row"), identified(model, F.col("text")).alias("p"))  # no name can clash
    return beside.where(~F.col("p.rejected")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
