"""Token counts as delta-maintained rollups.

A change feed has rows (op, source, lang, tokenizer, tokens, old_tokens): an insert adds a
document and its tokens, a delete takes them away, a revision adds the difference to its
old count. A batch of changes is summed to signed deltas per (source, lang, tokenizer)
and committed as one folder named by its batch id: committing a batch again replaces the
same folder, so retries never count twice. Totals are the sum over batches; compact()
folds them into a state, which lists what it has folded, so a late retry of a folded
batch is ignored.

Edge cases: null source or lang is a group of its own; null tokens count as 0; repeated
changes in one batch all count; an unknown op changes nothing; a group whose documents and
tokens come to 0 is not in the totals; an empty feed commits an empty batch; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import WORD, bounded_batches, shared_dir
from turnlake.llm.tokenizing import default_path, encoder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per key; op is 'insert', 'delete' or 'revise'."""
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("tokens", "old_tokens"))
    change = F.when(F.col("op") == "revise", tokens - old).otherwise(sign * tokens)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(change).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all machines share. Any number of commits may run beside one
    compaction; a second compaction at the same time is an error."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, prefix: str, *parts: str) -> list[str]:
        """Folders of a kind whose parts Spark's writer has marked as complete."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(n for n in names if n.startswith(prefix) and all(fs.exists(path(f"{self.path}/{n}/{p}_SUCCESS")) for p in parts))

    def batches(self) -> list[str]:
        return self._names("batch=", "")

    def state(self) -> str | None:
        """The last compaction; it counts once both of its parts are complete."""
        return max(self._names("state=", "totals/", "folded/"), default=None)

    def folded(self, state: str | None) -> set[str]:
        return {r.batch for r in self.spark.read.parquet(f"{self.path}/{state}/folded").collect()} if state else set()

    def snapshot(self) -> tuple[str | None, list[str]]:
        """The state and the complete batches that it has not folded, as of one listing: the
        batches are listed first, so a compaction in between can only have folded them."""
        listed, state = self.batches(), self.state()
        folded = self.folded(state)
        return state, [b for b in listed if b.removeprefix("batch=") not in folded]

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Write a batch's deltas; a batch that is folded already is left alone."""
        if batch not in self.folded(self.state()):
            deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def totals(self, at: tuple[str | None, list[str]] | None = None) -> DataFrame:
        """Totals of a snapshot, by default of one taken now."""
        state, batches = at or self.snapshot()
        use = batches + ([f"{state}/totals"] if state else [])
        if not use:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{b}" for b in use))
        out = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold one snapshot's batches into a new state: exactly these are summed, recorded as
        folded and deleted. Whoever reads meanwhile sees the old state or the new one; a batch
        committed meanwhile stays for the next time."""
        fs, path = self._fs()
        lock = path(f"{self.path}/compacting")
        if not fs.createNewFile(lock):
            raise RuntimeError(f"another compaction runs, or one has died and left {lock}")
        try:
            state, batches = self.snapshot()
            done = self.folded(state)
            late = [b for b in self.batches() if b.removeprefix("batch=") in done]  # retries of folded batches
            name = f"state={int(state.split('=')[1]) + 1 if state else 1:08d}"
            self.totals((state, batches)).write.mode("overwrite").parquet(f"{self.path}/{name}/totals")
            folded = sorted(done | {b.removeprefix("batch=") for b in batches})
            self.spark.createDataFrame([(b,) for b in folded], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/folded")
            for b in [*([state] if state else []), *batches, *late]:
                fs.delete(path(f"{self.path}/{b}"), True)
        finally:
            fs.delete(lock, False)


def bpe_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """docs (text and other columns) with column tokens in place of text; null text has none."""
    path = tokenizer or default_path()
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([len(enc.ids(t.as_py() or "")) // 4 for t in b.column(len(others))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], n], [*others, "tokens"])

    bounded_batches(docs.sparkSession)
    kept = docs.select(*others, "text")
    schema = kept.drop("text").schema.add("tokens", "long")
    return kept.mapInArrow(run, schema)


def documents_rollup(docs: DataFrame) -> DataFrame:
    """Totals of documents by two tokenizer versions, by way of the feed: inserts with word
    counts ("words") and with code points as a first estimate of BPE tokens; then a revision
    of the estimates by the BPE's counts; then compaction. Each text is read once a batch."""
    spark = docs.sparkSession
    rollup = Rollup(spark, shared_dir(spark))
    words, chars = (F.coalesce(c, F.lit(0)).cast("long") for c in (F.regexp_count("text", F.lit(WORD)), F.length("text")))
    keys = [F.col(c).cast("string").alias(c) for c in ("source", "lang")]
    both = F.array(F.struct(F.lit("words").alias("tokenizer"), words.alias("tokens")), F.struct(F.lit("word_bpe_49k").alias("tokenizer"), chars.alias("tokens")))
    inserts = docs.select(*keys, F.inline(both)).select(F.lit("insert").alias("op"), "*", F.lit(None).cast("long").alias("old_tokens"))
    rollup.commit("inserts", inserts)
    counted = bpe_counts(docs.select(*keys, chars.alias("old_tokens"), "text"))
    rollup.commit("bpe", counted.select(F.lit("revise").alias("op"), "source", "lang", F.lit("word_bpe_49k").alias("tokenizer"), "tokens", "old_tokens"))
    rollup.compact()
    return rollup.totals()
