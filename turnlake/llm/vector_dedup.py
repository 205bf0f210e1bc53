"""Near-duplicate vectors by a random-projection tree forest.

Every tree splits a node by the vectors' projection on the node's own random direction, at the
median, or a sparser place near it, of a bounded sample of SAMPLE vectors: of those that reach the
node or, where few do, of those that reached the last ancestor with enough, projected on
this direction. So splits follow the vectors at any depth, off-centre ones too. A node whose
vectors are too dense to be split without spilling most of them is a leaf. Vectors within a margin of a split go to both sides (spill overlap), so
near vectors seldom part; TREES trees miss a pair only if all of them part it. All
vectors are indexed; directions come from seeds and splits from the sample, so trees of any
depth need no other storage.

Vectors of a leaf with equal labels are compared in double precision, in tiles of at most
2 x TILE vectors: a dense leaf of any size is spread over tasks and never capped. A pair
is counted in the first leaf that holds both (each vector carries the leaves it is in),
so links are counted, not emitted; a tile returns one row per vector: links found and
the smallest vector it is joined with, whose union gives the components.

Equal vectors are one node with a multiplicity. Edge cases: null label; null, empty or
zero vector; null or non-finite components; vectors of other lengths: no link. An empty
table gives an empty result; repeated rows are vectors of their own; other columns are
ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from turnlake.llm.common import bounded_batches, by_group, components, discard, materialize

LEAST_COSINE = 0.98
TREES = 6
LEAF = 128
TILE = 2048
SAMPLE = 4096
#: Sampled vectors a node needs for a median.
LEAST_SAMPLED = 16
#: The margin, in standard deviations of two just-linked vectors' projected difference.
SPILL = 0.5
#: Quantiles of the sample where a node may be split, and the share of it that may then lie
#: within the margin: a denser node is a leaf, or its vectors would all be on both sides.
#: Other directions are tried first. (A split that spills more than 0.41 saves no comparisons.)
CUTS, MOST_SPILL, ATTEMPTS = (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7, 0.25, 0.75, 0.2, 0.8), 0.35, 4
SEED = 11
#: Nodes whose splits a worker keeps.
_NODES = 1 << 17


@functools.lru_cache(1 << 15)
def _direction(tree: int, path: int, dim: int, attempt: int) -> np.ndarray:
    r = np.random.default_rng((SEED, tree, path, attempt)).standard_normal(dim)
    return r / np.linalg.norm(r)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _margin(dim: int) -> float:
    return SPILL * math.sqrt(2 - 2 * LEAST_COSINE) / math.sqrt(dim)


class Forest:
    """Splits found as they are needed: path 1 is a tree's root, 2p and 2p + 1 are p's children."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.sample, self.depth, self.margin, self.nodes = sample, depth, _margin(sample.shape[1]), {}

    def node(self, tree: int, path: int) -> tuple[np.ndarray, float | None, np.ndarray]:
        """A node's direction, its split (None: a leaf), and the sample rows that stand for it."""
        got = self.nodes.get((tree, path))
        if got is None:
            rows = np.arange(len(self.sample))
            if path > 1:
                direction, cut, above = self.node(tree, path // 2)
                rows = above[(self.sample[above] @ direction > cut) == bool(path & 1)]
                rows = rows if len(rows) >= LEAST_SAMPLED else above
            for attempt in range(ATTEMPTS):
                direction = _direction(tree, path, self.sample.shape[1], attempt)
                cut = self._cut(self.sample[rows] @ direction)
                if cut is not None:
                    break
            got = direction, cut, rows
            if len(self.nodes) < _NODES:
                self.nodes[tree, path] = got
        return got

    def _cut(self, p: np.ndarray) -> float | None:
        """The place nearest the median of projections p that few enough have within the margin,
        if there is one: a dense group has none."""
        if not len(p):
            return None
        cuts = np.quantile(p, CUTS)
        spilled = (np.abs(p[None, :] - cuts[:, None]) <= self.margin).mean(axis=1)
        good = np.flatnonzero(spilled <= MOST_SPILL)
        return float(cuts[good[0]]) if len(good) else None

    def leaves(self, unit: np.ndarray) -> list[list[int]]:
        """Per vector the codes of all its leaves, in order of trees."""
        out: list[list[int]] = [[] for _ in unit]
        for tree in range(TREES):
            todo = [(1, np.arange(len(unit)))]
            while todo:
                path, rows = todo.pop()
                if not len(rows):
                    continue
                direction, cut, _ = self.node(tree, path) if path.bit_length() <= self.depth else (None, None, None)
                if cut is None:
                    for i in rows.tolist():
                        out[i].append(tree << 48 | path)
                    continue
                p = unit[rows] @ direction - cut
                todo += [(2 * path, rows[p <= self.margin]), (2 * path + 1, rows[p > -self.margin])]
        return out


INDEXED = "label string, leaf long, node long, copies long, vector binary, leaves binary"


def _index(shared, depth: int, dtype: str):
    """shared: a broadcast of the sample per length of vector. Vectors stay in their own type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = {dim: Forest(sample.astype(np.float64), depth) for dim, sample in shared.value.items()}
        for batch in batches:
            label, node, copies, vector = (batch.column(k).to_pylist() for k in range(4))
            dims = np.array([len(v) for v in vector])
            for dim in sorted(set(dims.tolist())):
                rows = np.flatnonzero(dims == dim)
                x = np.array([vector[i] for i in rows], dtype)
                forest = forests.get(dim) or forests.setdefault(dim, Forest(np.zeros((0, dim)), depth))
                codes = forest.leaves(_unit(x.astype(np.float64)))
                out = [(label[i], leaf, node[i], copies[i], v, c) for i, own, v, c in zip(rows.tolist(), codes, map(np.ndarray.tobytes, x), (np.array(own, np.int64).tobytes() for own in codes), strict=True) for leaf in own]
                for at in range(0, len(out), 4000):
                    cols = list(zip(*out[at : at + 4000]))
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["label", "leaf", "node", "copies", "vector", "leaves"])

    return run


def _compare(g: dict[str, np.ndarray], dtype: str) -> tuple | None:
    """One row per linked vector of a tile: (node, links counted here, smallest joined)."""
    leaf, i, j = (int(g[k][0]) for k in ("leaf", "i", "j"))
    unit = _unit(np.frombuffer(b"".join(g["vector"]), dtype).astype(np.float64).reshape(len(g["node"]), -1))
    block, node, copies = g["block"], g["node"], g["copies"]
    one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
    own = [np.frombuffer(v, np.int64) for v in g["leaves"]]
    codes = np.full((len(own), max(map(len, own))), -1, np.int64)
    for k, v in enumerate(own):
        codes[k, : len(v)] = v
    codes[codes >= leaf] = -1  # only leaves before this one matter
    if any((codes == c).any(axis=1).all() for c in codes[0] if c >= 0):
        return None  # a leaf before this one holds the whole tile
    found = []
    for at in range(0, len(one), 256):
        hit = unit[one[at : at + 256]] @ unit[two].T >= LEAST_COSINE
        if i == j:
            hit = np.triu(hit, at + 1)
        a, b = np.nonzero(hit)
        found.append((one[at + a].astype(np.int32), two[b].astype(np.int32)))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32),) * 2
    if not len(a):
        return None
    counted = np.ones(len(a), bool)
    for at in range(0, len(a), 20_000):
        x, y = codes[a[at : at + 20_000]], codes[b[at : at + 20_000]]
        for k in range(codes.shape[1]):
            counted[at : at + 20_000] &= ~((x[:, k] >= 0)[:, None] & (x[:, k : k + 1] == y)).any(axis=1)
    links = np.zeros(len(node), np.int64)
    for x, y in ((a[counted], b[counted]), (b[counted], a[counted])):
        links += np.bincount(x, weights=copies[y], minlength=len(node)).astype(np.int64)
    low = node.copy()
    while len(a):
        m = np.minimum(low[a], low[b])
        if (m == low[a]).all() and (m == low[b]).all():
            break
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
    some = np.zeros(len(node), bool)
    some[a] = some[b] = True
    return node[some], links[some], low[some]


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) to vec_id, n_links, component_id, kept; one row per input row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    finite = "size(embedding) > 0 and forall(embedding, x -> x is not null and x = x and abs(x) < double('inf') and not isnan(x)) and exists(embedding, x -> x <> 0)"
    usable = rows.where("label is not null and vec_id is not null and embedding is not null").where(finite)
    nodes = materialize(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    depth = max(0, math.ceil(math.log2(most / LEAF)))
    dtype = "f4" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "f8"
    by_dim: dict[int, list] = {}
    for r in nodes.select("embedding").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect():
        by_dim.setdefault(len(r.embedding), []).append(r.embedding)
    sample = spark.sparkContext.broadcast({dim: _unit(np.array(x, np.float64)).astype(np.float32) for dim, x in by_dim.items()})  # SAMPLE vectors
    labelled = nodes.select(F.concat_ws(":", F.size("embedding").cast("string"), "label").alias("label"), "node", "copies", "embedding")
    entries = materialize(labelled.mapInArrow(_index(sample, depth, dtype), INDEXED))
    sizes = materialize(entries.groupBy("label", "leaf").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("k"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    tiled = entries.join(sizes, ["label", "leaf"]).withColumn("block", F.pmod(F.xxhash64("node"), "k"))
    tiled = tiled.withColumn("t", F.explode(F.expr("transform(sequence(0L, k - 1), x -> struct(least(block, x) as i, greatest(block, x) as j))")))
    tiled = tiled.select("label", "leaf", "t.i", "t.j", "block", "node", "copies", "vector", "leaves")
    found = materialize(by_group(tiled, ["label", "leaf", "i", "j"], lambda g: _compare(g, dtype), "node long, links long, low long"))
    comp = materialize(components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))).toDF("c", "component")
    links = found.groupBy(F.col("node").alias("l")).agg(F.sum("links").alias("links"))
    of = nodes.join(links, F.col("node") == F.col("l"), "left").join(comp, F.col("node") == F.col("c"), "left")
    of = materialize(of.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")))
    for x in (entries, sizes, found):
        discard(x)
    out = rows.join(of.withColumnsRenamed({"label": "l", "embedding": "e"}), (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    out = out.select("vec_id", F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("links")), F.lit(0)).alias("n_links"), F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
