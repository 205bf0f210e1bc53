"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of all words, stopped at ``max_epochs`` times
its size; what a stop frees is reshared by weight until no target is above its stop.
With stops sorted by stop/weight, the level of the water has a closed form in prefix
sums, so the fixed point needs one window over the per-source table, not a loop.

A source with ratio r = target/size takes every document floor(r) times; the words of
the fraction come from its documents in order of a seeded hash, and the document that
crosses the target is taken in part, so each source meets its target to the word.
The order needs no global sort: hash buckets are summed first, and only the bucket in
which the target falls is sorted.

Edge cases: null text has size 0; a null source is a source of its own (last in
order); an empty table gives an empty result; sources without words take nothing;
repeated rows are mixed like other rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) plus target. sources has one row per source."""
    s = sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cap_before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_from")
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # the first feasible level in this order is the lowest that no later stop undercuts
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def hash_of(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _sized(docs: DataFrame, seed: str, *carry: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), hash_of(F.col("doc_id"), seed).alias("h"), *carry)
    return rows.withColumn("bucket", F.substring("h", 1, 3))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: Column | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken,
    whole (times it is taken whole) and part (words of one more, partial repetition).
    carry: one more column, such as a struct of the row, that stays beside its plan."""
    sized = materialize(_sized(docs, seed))
    buckets = materialize(sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    sources = buckets.groupBy("source").agg(F.sum("n").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")))
    s = water_fill(sources, max_epochs)
    s = s.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    s = s.select(F.col("source").alias("s"), "source_size", "target", "whole", "need")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(s, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("n")))
        .select(F.col("source").alias("e"), "bucket", "before")
    )
    s = materialize(
        s.join(edge, F.col("s").eqNullSafe(F.col("e")), "left")
        .select("s", "source_size", "target", "whole", "need", F.coalesce("bucket", F.lit("g")).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))
    )
    rows = sized if carry is None else _sized(docs, seed, carry.alias("_row"))  # no join brings a row to its plan
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("s")))  # one row per source: Spark broadcasts it if small
    clear = rows.where("bucket <> edge").withColumn("part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    done = Window.partitionBy("s").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where("bucket = edge").withColumn("part", F.col("before") + F.coalesce(F.sum("size").over(done), F.lit(0)))
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("need") - F.col("part"))))
    out = clear.unionByName(at_edge)
    # a part as long as the document is one more whole repetition
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part", *(["_row"] if carry is not None else []))


def repeat(docs: DataFrame, **parameters) -> DataFrame:
    """docs with each row as often as the mix takes it; the one document per source
    that is taken in part is cut after its last taken word."""
    words = F.split("_row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each with the space before it
    cut = F.array_join(F.slice(words, 1, F.col("part").cast("int")), "")
    whole = F.expr("array_repeat(false, cast(whole as int))")
    times = F.concat(whole, F.when(F.col("part") > 0, F.array(F.col("part") < F.col("size"))).otherwise(F.expr("cast(array() as array<boolean>)")))
    out = mix(docs, carry=F.struct(*docs.columns), **parameters).withColumn("_cut", F.explode(times))
    text = F.when(F.col("_cut"), cut).otherwise(F.col("_row.text"))
    rest = {"text": text}
    if "n_chars" in docs.columns:
        rest["n_chars"] = F.when(F.col("_cut"), F.length(text).cast("long")).otherwise(F.col("_row.n_chars"))
    return out.select(*(rest.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
