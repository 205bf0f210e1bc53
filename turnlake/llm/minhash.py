"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A document's set is its distinct five-word shingles (64-bit hashes), A-Z lower-cased.
Two permutations of the hash space make the whole signature: the first breaks up the
set's structure; the second, applied at circular shifts 0 to 127, gives coordinate k as
the least permuted value at shift k (C-MinHash, Li and Li, 2022). 32 bands of 4 rows
miss a pair of similarity 0.75 with probability (1 - 0.75^4)^32 = 5e-6.

Documents with equal sets are one node. In each band bucket every node is first paired
with the smallest, and pairs whose signatures allow a link are verified on full sets.
Where a bucket then still holds several components, signatures tell which nodes may link
with one of another component; only these are compared on full sets, in families of
components that they may join. Both go in tiles of bounded rows and bytes that return a
forest of links, not pairs. A group's largest component is never compared with itself, so
its rows are copied once per block of the other rows, and a group that is one component but
for a few rows costs little more than its number: no bucket is skipped or capped.

Edge cases: null, empty or blank texts have no set and link with nothing; shorter texts
than five words are one shingle; texts of any length are compared whole; rows that share a
doc_id are compared each by its own text, and each gets the component of its own set; a
null doc_id links with nothing and is kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_batches, by_group, components, discard, materialize

WIDTH = 5
SIMILAR = (75, 100)
BANDS, ROWS = 32, 4
#: A signature's share of equal coordinates below which a pair is not verified: 0.75
#: less five standard deviations of an estimate from 128 coordinates.
LEAST_ESTIMATE = 0.56
#: A block's rows and bytes of hashed sets; a tile compares two blocks.
TILE, TILE_BYTES = 1024, 16 << 20
#: Bytes of texts and number of words hashed at once; words of more bytes are hashed singly.
TEXT_BYTES, WORDS_AT_ONCE, SHORT_WORD = 4 << 20, 1 << 14, 64
_WORDS = np.uint64(0x9E3779B97F4A7C15)
_SIGMA = np.uint64(0xBF58476D1CE4E5B9)
_PI = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


@functools.cache
def _byte_table() -> np.ndarray:
    """A mixed 64-bit value for each (place in a word, byte)."""
    x = np.arange(1, SHORT_WORD * 256 + 1, dtype=np.uint64) * _WORDS
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * _SIGMA
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty words, by tabulation; those of over SHORT_WORD bytes by xxhash."""
    import xxhash

    offsets, size = words.buffers()[1], words.buffers()[2]
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, length = np.frombuffer(size, np.uint8), np.diff(at)
    out = np.empty(len(words), np.uint64)
    for lo in range(0, len(words), WORDS_AT_ONCE):
        ids = lo + np.flatnonzero(length[lo : lo + WORDS_AT_ONCE] <= SHORT_WORD)
        if len(ids):
            n = length[ids]
            first = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(first, n)
            out[ids] = np.add.reduceat(_byte_table()[place * 256 + data[place + np.repeat(at[ids], n)]], first)
    for i in np.flatnonzero(length > SHORT_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i + 1]].tobytes())
    return out


def _set_of(h: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words with hashes h."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(len(h), width)):
        out *= _WORDS
        out += h[k : k + n]
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]] if len(out) > 1 else out


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; about TEXT_BYTES of texts are split at once."""
    part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_BYTES
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(texts)] if len(texts) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo).fill_null("")))
        words, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        real = pc.greater(pc.binary_length(words), 0)  # not so at the ends of a text in white space
        ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][ends]
        h = _word_hashes(words.filter(real))
        for a, b in zip(ends[:-1], ends[1:]):
            yield _set_of(h[a:b], width)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return next(shingle_sets(pa.array([text], pa.string()), width))


@functools.cache
def _shifts(n: int) -> np.ndarray:
    return (np.arange(n, dtype=np.uint32) * _PI[0])[:, None]


def signature(s: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n circulant MinHash coordinates of a non-empty set."""
    x = s * _SIGMA  # sigma
    x = ((x ^ (x >> np.uint64(31))) >> np.uint64(16)).astype(np.uint32) * _PI[0]
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        v = x[None, at : at + 2048] + _shifts(n)  # pi's argument at every shift, times its first factor
        v ^= v >> np.uint32(15)
        v *= _PI[1]
        v ^= v >> np.uint32(13)
        v *= _PI[2]
        np.minimum(best, v.min(axis=1), out=best)
    return best


def _band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * _WORDS
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _short(sig: np.ndarray) -> bytes:
    """16 bits of each coordinate, for estimates."""
    return (sig * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16).tobytes()


SIGNED = "doc_id long, n_shingles long, key binary, bands array<long>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        n, key, bands, sig = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            if len(s):
                c = signature(s)
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(_band_keys(c))
                sig.append(_short(c))
            else:
                key.append(None)
                bands.append(None)
                sig.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "key", "bands", "sig"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) whose full sets are similar enough."""
    for batch in batches:
        keep, seen = [], {}
        for b, one, two in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(2)), batch.column(3), strict=True):
            if b not in seen:  # neighbours often share one side
                seen = {b: shingles(two.as_py())}
            keep.append(_similar(one, seen[b]))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _may_link(sig: np.ndarray, n: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Those of places b whose size and signature allow a link with place a, likeliest first."""
    b = b[SIMILAR[1] * np.minimum(n[b], n[a]) >= SIMILAR[0] * np.maximum(n[b], n[a])]
    same = (sig[b] == sig[a]).sum(axis=1)
    order = np.argsort(-same, kind="stable")
    return b[order][same[order] >= LEAST_ESTIMATE * sig.shape[1]]


def _sides(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a tile's two blocks."""
    return np.flatnonzero(g["block"] == g["i"][0]), np.flatnonzero(g["block"] == g["j"][0])


def _forest(label: np.ndarray, comp: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Edges that join what label joins beyond comp: one per component, to the first of its label."""
    if (label == comp).all():
        return None
    first: dict[int, int] = {}
    edges: dict[tuple[int, int], tuple[int, int]] = {}
    for x, c, d in sorted(zip(label.tolist(), comp.tolist(), doc.tolist())):
        low = first.setdefault(x, d)
        edges.setdefault((x, c), (low, d))
    out = np.array([e for e in edges.values() if e[0] != e[1]], np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _coarse_tile(g: dict[str, np.ndarray]) -> tuple | None:
    """By signatures: a forest (a, b) over a tile's components that may link, and (d, d) for
    each row that may link with one of another component."""
    sig, (one, two) = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g["sig"]), -1), _sides(g)
    comp, n = g["comp"], g["n"]
    label, some = comp.copy(), np.zeros(len(comp), bool)
    for at in range(0, len(one), 16):
        a = one[at : at + 16]
        small, large = np.minimum(n[a][:, None], n[two][None, :]), np.maximum(n[a][:, None], n[two][None, :])
        may = (comp[a][:, None] != comp[two][None, :]) & (SIMILAR[1] * small >= SIMILAR[0] * large)
        cols = np.flatnonzero(may.any(axis=0))
        if not len(cols):
            continue
        may = may[:, cols]
        may &= (sig[a][:, None, :] == sig[two[cols]][None, :, :]).sum(axis=2) >= LEAST_ESTIMATE * sig.shape[1]
        some[a] |= may.any(axis=1)
        some[two[cols]] |= may.any(axis=0)
        for x, y in {(x, y) for i, j in zip(*np.nonzero(may)) if (x := label[a[i]]) != (y := label[two[cols[j]]])}:
            label[label == label[comp == y][0]] = label[comp == x][0]
    if not some.any():
        return None
    edges = _forest(label, comp, g["doc"])
    own = g["doc"][some]
    return (np.r_[edges[0], own], np.r_[edges[1], own]) if edges else (own, own)


def _exact_tile(g: dict[str, np.ndarray]) -> tuple | None:
    """A forest over a tile's components with links between them, verified on full sets."""
    sig, (one, two) = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g["sig"]), -1), _sides(g)
    comp, n = g["comp"], g["n"]
    sets = list(shingle_sets(pa.array(g["text"], pa.string())))
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(ids, np.cumsum([len(x) for x in sets])[:-1])
    size, mark = np.array([len(x) for x in sets]), np.zeros(len(words), np.int64)
    label = comp.copy()
    for a in one:
        left = _may_link(sig, n, a, two[label[two] != label[a]])
        for at in range(0, len(left), 256):  # the likeliest first: most find their partners among these
            b = left[at : at + 256]
            b = b[label[b] != label[a]]
            if not len(b):
                continue
            mark[sets[a]] = 1
            both = np.add.reduceat(mark[np.concatenate([sets[i] for i in b])], np.r_[0, np.cumsum(size[b])[:-1]])
            mark[sets[a]] = 0
            for x in np.unique(label[b[SIMILAR[1] * both >= SIMILAR[0] * (size[a] + size[b] - both)]]).tolist():
                label[label == x] = label[a]
    return _forest(label, comp, g["doc"])


def _estimate_allows(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    return bool((x == y).sum() >= LEAST_ESTIMATE * len(x))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose full sets are similar."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))


def _tiles(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, doc, comp, n, ...) of groups of any size, dealt as pairs of blocks i <= j of
    about TILE rows and TILE_BYTES of hashed sets. Blocks before k hold the rows outside the
    group's largest component, the others this component; no pair has both blocks of it."""
    per = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    top = F.max_by(F.struct("comp", "m", "w"), F.struct("m", "comp"))
    blocks = lambda m, w: F.greatest(F.lit(1), F.ceil(m / TILE), F.ceil(8 * w / TILE_BYTES)).cast("long")
    per = per.groupBy(group).agg(top.alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    k = per.select(group, F.col("top.comp").alias("top"), blocks(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")).alias("k"), blocks(F.col("top.m"), F.col("top.w")).alias("l"))
    at = F.when(F.col("comp") == F.col("top"), F.col("k") + F.pmod(F.xxhash64("doc"), "l")).otherwise(F.pmod(F.xxhash64("doc"), "k"))
    dealt = rows.join(k, group).withColumn("block", at)
    pairs = F.expr("transform(sequence(0L, if(block < k, k + l - 1, k - 1)), x -> struct(least(block, x) as i, greatest(block, x) as j))")
    return dealt.withColumn("t", F.explode(pairs)).withColumns({"i": F.col("t.i"), "j": F.col("t.j")}).drop("t", "k", "l", "top")


def _with_component(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """rows (doc, ...) plus name: the component of doc in the graph of links, itself without one."""
    c = materialize(components(links).toDF("_d", "_c"))
    return rows.join(c, rows["doc"] == c["_d"], "left").withColumn(name, F.coalesce("_c", "doc")).drop("_d", "_c")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id, kept; one row per input row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    signed = materialize(texts.mapInArrow(_sign, SIGNED))
    with_set = signed.where("n_shingles > 0 and doc_id is not null")
    # one node per distinct set
    node_of = materialize(with_set.groupBy("key").agg(F.min("doc_id").alias("node")))
    nodes = materialize(
        with_set.join(node_of.select(F.col("node").alias("doc_id"), F.col("key").alias("k")), "doc_id").where("key = k").dropDuplicates(["doc_id", "key"])
        .select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "bands", "sig")
    )
    in_bands = nodes.select("doc", F.explode("bands").alias("band"))
    buckets = in_bands.groupBy("band").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    shared = materialize(in_bands.join(buckets, "band"))
    # the texts that any comparison may need; always dealt by key, since the ids grow with the corpus
    ids = shared.select(F.col("doc").alias("id")).distinct()
    texts = materialize(texts.join(ids.hint("merge"), "id", "left_semi").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h"))
    sides = nodes.select("doc", "n", "sig")
    # each node with the first of its bucket
    pairs = (
        shared.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
        .join(sides.toDF("a", "na", "sig_a"), "a").join(sides.toDF("b", "nb", "sig_b"), "b")
        .where(F.lit(SIMILAR[1]) * F.least("na", "nb") >= F.lit(SIMILAR[0]) * F.greatest("na", "nb"))
        .where(F.udf(_estimate_allows, "boolean", useArrow=True)("sig_a", "sig_b")).select("a", "b")
    )
    linked = _verified(pairs, texts)
    # buckets that still hold several components: which of their nodes may link beyond their own, by signatures
    of = materialize(_with_component(shared.select("band", "doc"), linked, "comp"))
    open_ = of.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    sizes = nodes.select("doc", "n")
    rows = _tiles(of.join(open_, "band", "left_semi").join(sizes, "doc"), "band").join(nodes.select("doc", "sig"), "doc")
    found = materialize(by_group(rows.select("band", "i", "j", "block", "doc", "comp", "n", "sig"), ["band", "i", "j"], _coarse_tile, "a long, b long"))
    # families of components that may link: these nodes are compared on full sets
    of_doc = materialize(of.select("doc", "comp").distinct())
    stars = of_doc.where("doc <> comp").select(F.col("comp").alias("a"), F.col("doc").alias("b"))
    some = of_doc.join(found.where("a = b").select(F.col("a").alias("doc")).distinct(), "doc", "left_semi")
    family = materialize(_with_component(some, stars.unionByName(found.where("a <> b").distinct()), "family").join(sizes, "doc"))
    rows = _tiles(family, "family").join(nodes.select("doc", "sig"), "doc").join(texts.withColumnRenamed("id", "doc"), "doc")
    rows = rows.select("family", "i", "j", "block", "doc", "comp", "n", "sig", "text")
    more = materialize(by_group(rows, ["family", "i", "j"], _exact_tile, "a long, b long"))
    by_key = _with_component(node_of.withColumnRenamed("node", "doc"), stars.unionByName(more), "component").select(F.col("key").alias("k"), "component")
    by_key = materialize(by_key)
    for x in (shared, of, of_doc, found, nodes, texts, family):
        discard(x)
    out = signed.select("doc_id", "n_shingles", "key").join(by_key, F.col("key") == F.col("k"), "left")
    out = out.withColumn("component_id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, without the near copies: of each component the rows with
    the smallest doc_id stay; a doc_id goes with all its rows if one of them is a copy of a
    smaller doc_id's. Documents without words and those with a null doc_id stay."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
