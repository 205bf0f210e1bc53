"""Phrase collocations by Apriori passes over the levels of phrase length.

Pass k counts the k-word phrases of every text, but emits one only if both its
overlapping (k-1)-word phrases are frequent in its language (>= MIN_COUNT). The frequent
phrases of a level are written as a table; what is broadcast is a bitmap of their hashes,
whose size has a fixed bound (MAX_BITS, 32 MiB). A bit that two phrases share only lets a
phrase through that then counts too little, so results are exact at any number of
phrases; beyond the bound, passes prune less. Tasks sum counts before they emit phrases,
and Spark sums again before it deals them.

Cuts are scored from the level tables: a candidate of count a cut into parts of counts l
and r has floor(1000000 a a / (l r)) in exact decimals, and its lowest cut counts. A
candidate goes if a longer one that holds it has at least half of its count. The first
TOP of each language are taken in rounds over ever fewer buckets of a hash, so no task
sees all of a language's candidates.

Edge cases: null text is empty; a null language is `und`, together with the language of
that name; texts without words count nothing; repeated rows count again; a text of any
length is read in slices that overlap by k - 1 words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_batches, materialize

MIN_COUNT = 10
TOP = 2000
LONGEST = 3
SCALE = 1_000_000
#: Bits per frequent phrase, and the most bits of a broadcast bitmap.
BITS, LEAST_BITS, MAX_BITS = 16, 1 << 20, 1 << 28
#: Bytes of text split at once; words and phrases that a task holds before it emits them.
SLICE, WORDS, PHRASES = 1 << 22, 900_000, 2_000_000
#: Bits of a word's number in a phrase's code, and the numbers that fit. A slice adds at most
#: a million different words to WORDS.
WORD_BITS, FIT = 21, 3

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes.maketrans(_BREAKS, b"." * len(_BREAKS))


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def phrase_hash(hashes: list[np.ndarray], lang: int) -> np.ndarray:
    """64-bit hash of phrases from their words' hashes; the same wherever it is computed."""
    out = np.full(len(hashes[0]), lang, np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def slices(text: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """text in slices of about limit bytes, cut at white space or a break."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(b" ", at, at + limit), text.rfind(b".", at, at + limit), text.rfind(b"\t", at, at + limit))
        if end <= at:  # one word longer than a slice
            ends = [e for e in (text.find(c, at + limit) for c in (b" ", b".", b"\t")) if e >= 0]
            if not ends:
                break
            end = min(ends)
        yield text[at:end]
        at = end
    yield text[at:]


class Words(dict):
    """word -> its number in this task; 0 is the break between pieces."""

    def __init__(self):
        self.list, self.hashes = [b"."], [0]
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.list)
        self.list.append(word)
        self.hashes.append(word_hash(word))
        return n


class Counter:
    """Counts of one language's k-word phrases in a task. A phrase is a code of its words' numbers;
    result batches wait in `out`."""

    def __init__(self, lang: str, k: int, bitmap: np.ndarray | None):
        self.lang, self.k, self.bitmap, self.seed = lang, k, bitmap, word_hash(lang.encode())
        self.out: list[pa.RecordBatch] = []
        self.clear()

    def clear(self) -> None:
        self.words, self.hashes, self.frequent = Words(), np.zeros(1, np.uint64), np.zeros(1, bool)
        self.codes, self.counts, self.new, self.n_new = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def hit(self, hashes: list[np.ndarray]) -> np.ndarray:
        at = phrase_hash(hashes, self.seed) & np.uint64(len(self.bitmap) * 8 - 1)
        return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def add(self, text: bytes) -> None:
        """Count a text that is already lower-cased and has one kind of break."""
        tail = []
        for part in slices(text):
            if len(self.words.list) > WORDS or len(self.codes) > PHRASES:
                self.emit()
            tokens = tail + part.replace(b".", b" . ").split()
            tail = tokens[len(tokens) - self.k + 1 :] if self.k > 1 else []
            ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
            known = len(self.hashes)
            if len(self.words.list) > known:
                self.hashes = np.append(self.hashes, np.array(self.words.hashes[known:], np.uint64))
                if self.k == 2:
                    self.frequent = np.append(self.frequent, self.hit([self.hashes[known:]]))
            self._count(ids)

    def _count(self, ids: np.ndarray) -> None:
        k, n = self.k, len(ids) - self.k + 1
        if n <= 0:
            return
        if k == 1:
            keep = ids > 0
        elif k == 2:
            ok = self.frequent[ids]
            keep = ok[:-1] & ok[1:]
        else:  # both overlapping phrases of k - 1 words
            ok = np.lib.stride_tricks.sliding_window_view(ids > 0, k - 1).all(1)
            where = np.flatnonzero(ok)
            ok[where] = self.hit([self.hashes[ids[where + j]] for j in range(k - 1)])
            keep = ok[:-1] & ok[1:]
        at = np.flatnonzero(keep)
        code = ids[at]
        for j in range(1, min(k, FIT)):
            code = code << WORD_BITS | ids[at + j]
        self.new.append(code if k <= FIT else np.stack([code, *(ids[at + j] for j in range(FIT, k))], 1))
        self.n_new += len(at)
        if self.n_new > PHRASES:
            self.merge()

    def merge(self) -> None:
        """Sum equal codes; longer phrases than fit in a code are rows of numbers."""
        if self.n_new:
            new, n = np.unique(np.concatenate(self.new), return_counts=True, axis=0 if self.k > FIT else None)
            if len(self.codes):
                both, place = np.unique(np.concatenate([self.codes, new]), return_inverse=True, axis=0 if self.k > FIT else None)
                self.counts = np.bincount(place.ravel(), np.concatenate([self.counts, n]), len(both)).astype(np.int64)
                self.codes = both
            else:
                self.codes, self.counts = new, n
        self.new, self.n_new = [], 0

    def size(self) -> int:
        return len(self.codes) + self.n_new + len(self.words.list)

    def emit(self) -> None:
        self.merge()
        words = pa.array(self.words.list, pa.binary())
        for a in range(0, len(self.codes), 100_000):
            part = self.codes[a : a + 100_000]
            first, rest = (part[:, 0], list(part.T[1:])) if self.k > FIT else (part, [])
            k = min(self.k, FIT)
            ids = [first >> (WORD_BITS * (k - 1 - j)) & ((1 << WORD_BITS) - 1) for j in range(k)] + rest
            parts = [words.take(pa.array(i)) for i in ids]
            phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if self.k > 1 else parts[0]
            lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([self.lang])).cast(pa.string())
            self.out.append(pa.RecordBatch.from_arrays([lang, phrases.cast(pa.string()), pa.array(self.counts[a : a + 100_000])], ["lang", "phrase", "n"]))
        self.clear()

    def taken(self) -> list[pa.RecordBatch]:
        out, self.out = self.out, []
        return out


def counted(docs: DataFrame, k: int, bitmap: np.ndarray | None) -> DataFrame:
    """(lang, phrase, n) of the k-word phrases that a bitmap of the level below lets through."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counters = shared.value if shared is not None else None, {}
        for batch in batches:
            texts = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                texts.setdefault(lang, []).append(text.as_py())
            for lang, parts in texts.items():
                c = counters.get(lang) or counters.setdefault(lang, Counter(lang, k, bits))
                c.add(b"".join(x.lower().translate(_TO_BREAK) + b"." for x in parts))
                yield from c.taken()
            if sum(c.size() for c in counters.values()) > 2 * (WORDS + PHRASES):
                for c in counters.values():
                    c.emit()
                    yield from c.taken()
                counters = {}
        for c in counters.values():
            c.emit()
            yield from c.taken()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap_of(phrases: DataFrame) -> np.ndarray:
    """The frequent phrases' hashes as a bitmap of at most MAX_BITS. Spark builds its blocks;
    the driver gets no more than these."""
    n = phrases.count()
    bits = min(MAX_BITS, max(LEAST_BITS, 1 << (max(1, n * BITS) - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = {}
        for b in batches:
            out = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist()):
                seed = seeds.get(lang) or seeds.setdefault(lang, word_hash(lang.encode()))
                hashes = [np.array([word_hash(w)], np.uint64) for w in phrase.encode().split(b" ")]
                out.append(int(phrase_hash(hashes, seed)[0]) & (bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["at"])

    at = phrases.select("lang", "phrase").mapInArrow(places, "at bigint").select((F.col("at") + 1).alias("at"))
    blocks = at.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        start = (r["block"] - 1) * 4096
        out[start : start + len(part)] = part[: len(out) - start]
    return out


def levels(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and the written tables (lang, phrase, n) of frequent phrases by length."""
    bounded_batches(docs.sparkSession)
    words = materialize(counted(docs, 1, None))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = [materialize(words.where(F.col("n") >= min_count))]
    for k in range(2, longest + 1):
        out.append(materialize(counted(docs, k, bitmap_of(out[-1])).where(F.col("n") >= min_count)))
    return totals, out


def scored(tables: list[DataFrame]) -> DataFrame:
    """Candidates of 2 words and more: lang, phrase, a, l, r and score of the lowest cut; ties take
    the earliest cut. Contained ones with half of their count in a longer one are gone."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    out = None
    for k in range(2, len(tables) + 1):
        words = F.split("phrase", " ")
        best = tables[k - 1].select("lang", "phrase", F.col("n").alias("a"))
        cuts = []
        for j in range(1, k):
            left, right = (tables[i - 1].select(F.col("lang").alias(f"_{s}"), F.col("phrase").alias(f"_p{s}"), F.col("n").alias(f"{s}{j}")) for i, s in ((j, "l"), (k - j, "r")))
            part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
            best = best.join(left, (F.col("lang") == F.col("_l")) & (part(1, j) == F.col("_pl"))).drop("_l", "_pl")
            best = best.join(right, (F.col("lang") == F.col("_r")) & (part(j + 1, k - j) == F.col("_pr"))).drop("_r", "_pr")
            score = F.expr(f"cast(cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * {SCALE} div (cast(l{j} as decimal(19,0)) * cast(r{j} as decimal(19,0))) as bigint)")
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("k"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
        best = best.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        if k < len(tables):  # its longer candidates of one more word hold all still longer ones' parts
            best = best.join(_held(tables[k:], k), ["lang", "phrase"], "left").where("coalesce(100 * cast(longer as decimal(19,0)) < 50 * cast(a as decimal(19,0)), true)").drop("longer")
        out = best if out is None else out.unionByName(best)
    return out


def _held(longer: list[DataFrame], k: int) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer candidate that holds a k-word phrase.
    A phrase's count is at least that of any longer one around it, so k + 1 words tell."""
    w = F.split("phrase", " ")
    both = F.array(F.array_join(F.slice(w, 1, k), " "), F.array_join(F.slice(w, 2, k), " "))
    return longer[0].select("lang", "n", F.explode(both).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def first_of_each(rows: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """The first `top` rows per lang with their rank from 1, by rounds over 4096, 64 and 1 buckets."""
    h = F.pmod(F.xxhash64("phrase"), F.lit(4096))
    for n in (4096, 64, 1):
        w = Window.partitionBy("lang", h % n).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return rows


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    totals, tables = levels(docs, longest, min_count)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    out = first_of_each(materialize(scored(tables)), top, order)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
