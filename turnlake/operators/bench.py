"""Benchmark runs: chunks, medians, latest rows, exactness, decisions, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import seq


#: Keys whose hashes are lowest, from which the bounds of ranges are taken; ranges at most.
SAMPLED, RANGES = 20_000, 1024


def range_bounds(df: DataFrame, order: str, ranges: int | None = None) -> list:
    """Keys that cut df into about even ranges: quantiles of the SAMPLED keys with the lowest hashes.
    Keys, not rows, are sampled, so that reruns agree whatever the input's partitions are."""
    ranges = min(ranges or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), RANGES)
    keys = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(SAMPLED)
    found = [r[0] for r in keys.distinct().orderBy(order).collect()]
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if len(found) > 1 else []


def range_of(key: Column, bounds: list, kind) -> Column:
    """The number of bounds at or below a key, by bisection; nulls are in range 0."""
    if not bounds:
        return F.lit(0)
    held = F.array(*(F.lit(b).cast(kind) for b in bounds))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def half(at: Column, _: Column) -> Column:  # the answer lies in at.lo..at.hi
        mid = ((at["lo"] + at["hi"]) / 2).cast("int")
        right = (at["lo"] < at["hi"]) & F.coalesce(F.get(held, mid) <= key, F.lit(False))
        return F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), half, lambda a: a["lo"])


def numbered(df: DataFrame, order: str, name: str = "at") -> DataFrame:
    """The rows of numbered_total alone."""
    return numbered_total(df, order, name)[0]


def numbered_total(df: DataFrame, order: str, name: str = "at") -> tuple[DataFrame, int]:
    """df, and how many rows it has, plus its rows' places from 0 in order of a key (nulls first; equal keys in any order).

    Ranges have fixed bounds, so their counts and the rows' numbers always agree, whatever
    partitions Spark makes of them. Bounds and counts are a few numbers per range; a range is
    one task's sort, so `order` should be nearly unique. Runs two small jobs when called."""
    bounds = range_bounds(df, order)
    at = range_of(F.col(order), bounds, df.schema[order].dataType)
    found = {r[0]: r[1] for r in df.select(at.alias("p")).groupBy("p").agg(F.count(F.lit(1))).collect()}
    base, before = [], 0
    for p in range(len(bounds) + 1):
        base.append(before)
        before += found.get(p, 0)
    rows = df.withColumn("_p", at)
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.get(F.array(*(F.lit(b).cast("bigint") for b in base)), F.col("_p"))
    return rows.withColumn(name, place).drop("_p"), before


def chunked(df: DataFrame, order: str, size: int) -> DataFrame:
    """df plus chunk and place in it, in order; the remainder is last."""
    if size < 1:
        raise ValueError("size must be >= 1")
    at = numbered(df, order, "_at")
    return at.select(*df.columns, F.floor(F.col("_at") / size).alias("chunk"), (F.col("_at") % size).alias("place"))


def run_medians(runs: DataFrame, *by: str) -> DataFrame:
    """runs (by, wall_s, gen_tokens, prompt_tokens) to medians of wall and rates."""
    rate = lambda c: F.try_divide(c, F.col("wall_s"))
    m = lambda c: F.percentile(c, 0.5)
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), m(F.col("wall_s")).alias("median_wall_s"), m(rate(F.col("gen_tokens"))).alias("median_gen_tok_s"), m(rate(F.col("gen_tokens") + F.col("prompt_tokens"))).alias("median_total_tok_s"))


def latest_per_key(df: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """The values of each key's last row of an append-only log; pre-aggregated, no window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")


def find_run(benches: DataFrame, order: str, **match) -> DataFrame:
    """The most recent bench row (not of an exactness gate) that matches."""
    cond = (F.col("kind") == "bench") & ~F.endswith("tag", F.lit("exactness"))
    for k, v in match.items():
        cond = cond & F.col(k).eqNullSafe(F.lit(v))
    return benches.where(cond).orderBy(F.desc(order)).limit(1)


def exactness(base: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, output_ids) on both sides to divergences; an id on one side alone is an error."""
    b, o = base.select("query_id", F.col("output_ids").alias("b")), other.select("query_id", F.col("output_ids").alias("o"))
    j = b.join(o, "query_id", "full_outer")
    ok = F.when(F.col("b").isNull() | F.col("o").isNull(), F.raise_error(F.lit("outputs out of step")).cast("boolean")).otherwise(F.lit(True))
    return j.where(ok).select("query_id", seq.first_divergence(F.col("b"), F.col("o")).alias("first_divergence"), F.size("b").alias("len_baseline"), F.size("o").alias("len_spec"))


def exactness_summary(detail: DataFrame) -> DataFrame:
    bad = F.coalesce(F.sum(F.col("first_divergence").isNotNull().cast("bigint")), F.lit(0))
    n = F.count(F.lit(1))
    return detail.agg(n.alias("n_prompts"), (n - bad).alias("n_exact"), bad.alias("n_mismatch"), (bad == 0).alias("all_exact"))


def speedups(rows: DataFrame, keys: list[str], baseline: str = "ar") -> DataFrame:
    """rows (keys, method, tok_s) with speedup over the baseline method of the same keys."""
    ar = rows.where(F.col("method") == baseline).select(*keys, F.col("tok_s").alias("ar_tok_s"))
    return rows.where(F.col("method") != baseline).join(ar, keys, "left").withColumn("speedup", F.try_divide("tok_s", "ar_tok_s"))


def pick_best(candidates: DataFrame, priority: str) -> DataFrame:
    """The candidate with the highest speedup; ties go to the lowest priority value."""
    return candidates.orderBy(F.desc("speedup"), priority).limit(1)


def estimated_speedup(tau: Column, cost: Column) -> Column:
    return F.try_divide(tau + 1, cost)


def worst_gate(gates: DataFrame, order: str) -> DataFrame:
    return gates.orderBy("n_exact", order).limit(1)


def newest_checkpoint(names: DataFrame, column: str = "name") -> DataFrame:
    """The name with the highest numeric suffix."""
    return names.withColumn("step", F.regexp_extract(column, r"([0-9]+)$", 1).try_cast("bigint")).where("step is not null").orderBy(F.desc("step")).limit(1)


METHODS = ("ar", "ngram", "draft_model")


def spec_config(method: Column, k: Column, model: Column, lo: Column, hi: Column) -> Column:
    """A method's configuration as JSON; null for ar; a configuration that breaks a rule is an error."""
    bad = F.when(~method.isin(*METHODS), "unknown method").when((method != "ar") & (F.coalesce(k, F.lit(0)) < 1), "k must be at least 1")
    bad = bad.when((method == "draft_model") & (F.btrim(F.coalesce(model, F.lit(""))) == ""), "draft_model needs a model")
    bad = bad.when((method == "ngram") & ~F.coalesce((lo >= 1) & (lo <= hi), F.lit(False)), "lookup window must be 1 <= min <= max")
    ngram = F.to_json(F.struct(F.lit("ngram").alias("method"), k.alias("num_speculative_tokens"), lo.alias("prompt_lookup_min"), hi.alias("prompt_lookup_max")))
    draft = F.to_json(F.struct(F.lit("draft_model").alias("method"), model.alias("model"), k.alias("num_speculative_tokens")))
    return F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).when(method == "ngram", ngram).when(method == "draft_model", draft)


def grid(**axes: DataFrame) -> DataFrame:
    """All combinations of small one-column parameter tables."""
    out = None
    for df in axes.values():
        out = df if out is None else out.crossJoin(F.broadcast(df))
    return out


def region_extremes(regions: DataFrame) -> DataFrame:
    """The lowest and highest alpha over regions, and region 0's share of verified places."""
    zero = F.sum(F.when(F.col("region") == 0, F.col("n_verified")).otherwise(0))
    return regions.agg(F.min("alpha").alias("lowest"), F.max("alpha").alias("highest"), F.try_divide(zero, F.sum("n_verified")).alias("context_share"))


def positions_improved(trained: DataFrame, untuned: DataFrame) -> DataFrame:
    """How many places have an alpha at least as high as before. Both: pos, alpha_n."""
    j = trained.select("pos", F.col("alpha_n").alias("a")).join(untuned.select("pos", F.col("alpha_n").alias("b")), "pos")
    return j.agg(F.count(F.lit(1)).alias("n_positions"), F.coalesce(F.sum((F.col("a") >= F.col("b")).cast("bigint")), F.lit(0)).alias("n_improved"))


def sampling_seed(base: Column, step: Column, micro: Column, index: Column) -> Column:
    """A context's own seed."""
    return base + step * 1_000_003 + micro * 1_009 + index


def vocab_guard(model_vocab: int, real_vocab: int) -> int:
    """The real vocabulary's size; a smaller model is an error."""
    if model_vocab < real_vocab:
        raise ValueError(f"model vocabulary {model_vocab} under {real_vocab}")
    return real_vocab
