"""Joining generations to prompts, records and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import literals, seq
from turnlake.functions import text as T
from turnlake.schemas import NO_LOSS, REGION_CONTEXT, REGION_TAG, REGION_TOOL_CALL


def join_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts that a 1:1 join must have at zero: ids on one side only, duplicates; and the matches."""
    side = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    j = side(left, "l").join(side(right, "r"), key, "full_outer")
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return j.agg(
        one(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_matched"), one(F.col("r").isNull()).alias("n_left_only"), one(F.col("l").isNull()).alias("n_right_only"),
        one(F.coalesce(F.col("l") > 1, F.lit(False))).alias("n_left_dup"), one(F.coalesce(F.col("r") > 1, F.lit(False))).alias("n_right_dup"),
    )


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails unless ids are unique and equal on both sides."""
    r = join_report(left, right, key).withColumn("bad", F.expr("n_left_only + n_right_only + n_left_dup + n_right_dup"))
    ok = F.when(F.col("bad") > 0, F.raise_error(F.lit("ids do not match one to one")).cast("boolean")).otherwise(F.lit(True))
    return left.join(right, key).crossJoin(F.broadcast(r.select("bad"))).where(ok).drop("bad")


def kd_records(rows: DataFrame, *also: str) -> DataFrame:
    """rows (query_id, prompt_ids, gen_ids, lengths of generated tokens, calls and tags as spans,
    logprobs) to training records: loss on the generation alone, regions as run lengths.
    also: further columns to keep."""
    n = F.size("prompt_ids")
    gen_regions = seq.regions_of(seq.offsets(F.col("lengths")), [(F.col("tags"), REGION_TAG), (F.col("calls"), REGION_TOOL_CALL)])
    out = rows.withColumn("_r", F.concat(F.array_repeat(F.lit(REGION_CONTEXT), n), gen_regions))
    return out.select(
        "query_id", F.concat("prompt_ids", "gen_ids").alias("input_ids"), F.concat(F.array_repeat(F.lit(NO_LOSS), n), F.col("gen_ids")).alias("labels"), seq.rle(F.col("_r")).alias("regions"),
        n.alias("n_prompt_tokens"), (n + F.size("gen_ids")).alias("n_tokens"), F.size("calls").alias("n_tool_calls"), "gen_ids",
        F.transform("logprobs", lambda p: p["id"]).alias("gen_logprob_token_ids"), F.transform("logprobs", lambda p: p["lp"]).alias("gen_logprob_values"), *also,
    )


def drop_reasons(verdicts: DataFrame) -> DataFrame:
    """verdicts (problems array) to counts per reason.

    outer: no filter on the problems is inferred, which would be pushed down and find them anew."""
    return verdicts.select(F.posexplode_outer("problems").alias("i", "p")).where("i is not null").groupBy(T.reason_key(F.col("p")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def assembly_stats(verdicts: DataFrame) -> DataFrame:
    kept = F.coalesce(F.sum(F.col("valid").cast("bigint")), F.lit(0))
    n = F.count(F.lit(1))
    return verdicts.agg(n.alias("n"), kept.alias("n_kept"), (n - kept).alias("n_dropped"), F.round(F.try_divide(n - kept, n), 4).alias("drop_rate"))


def length_stats(df: DataFrame, length: str, *by: str) -> DataFrame:
    p = lambda q: F.percentile(length, q)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(length).cast("bigint").alias("total"), p(0.5).alias("median"), p(0.25).alias("p25"), p(0.95).alias("p95"), F.max(length).cast("bigint").alias("longest"))


def region_totals(records: DataFrame) -> DataFrame:
    """Tokens per region over records' run-length regions, and their share."""
    t = records.select(F.explode("regions").alias("r")).groupBy(F.col("r.code").alias("code")).agg(F.sum("r.len").cast("bigint").alias("n_tokens"), F.count(F.lit(1)).alias("n_runs"))
    return t


def gold_classes(pairs: DataFrame) -> DataFrame:
    """pairs (generated, gold call JSON) to counts of exact / other_args / wrong_function / no_call."""
    name, args = (lambda c: F.get_json_object(c, "$.name")), (lambda c: F.to_json(F.try_parse_json(F.get_json_object(c, "$.arguments"))))
    g, t = F.col("generated"), F.col("gold")
    cls = F.when(name(g).isNull(), "no_call").when(name(g) != name(t), "wrong_function").when(args(g).eqNullSafe(args(t)), "exact").otherwise("other_args")
    return pairs.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def opener_distribution(df: DataFrame, by: str) -> DataFrame:
    """Counts of first tokens per group, and their share of the group. df: by, first."""
    c = df.groupBy(by, "first").agg(F.count(F.lit(1)).alias("n"))
    return c.join(c.groupBy(by).agg(F.sum("n").alias("of")), by).select(by, "first", "n", F.round(F.col("n") / F.col("of"), 6).alias("share"))


def single_turn_messages(raw: DataFrame) -> DataFrame:
    """Raw single-turn rows (id, query, tools and answers as JSON) to query_id, messages (a user
    turn, then one assistant turn with all answer calls), converted tools and n_answers.
    Arguments keep their keys' order and their numbers; broken JSON is an error."""
    broken = lambda kind: F.raise_error(F.concat(F.lit("broken JSON in row "), F.col("id").cast("string"))).cast(kind)
    of_tool = "array<struct<name: string, description: string, parameters: map<string, struct<type: string, description: string, default: variant>>>>"
    of_call = "array<struct<name: string, arguments: string>>"
    rows = raw.withColumns({"_a": literals.calls(F.col("answers")), "_t": literals.json_text(F.col("tools"))})
    rows = rows.withColumn("_a", F.when(F.col("_a").isNull() & F.col("answers").isNotNull(), broken(of_call)).otherwise(F.col("_a")))
    tools = F.when(F.col("_t").isNull() & F.col("tools").isNotNull(), broken(of_tool)).otherwise(F.from_json("_t", of_tool, {"mode": "FAILFAST"}))
    none = F.expr("cast(null as array<struct<name: string, arguments: string>>)")
    user = F.struct(F.lit("user").alias("role"), F.col("query").alias("content"), none.alias("tool_calls"))
    turn = F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), F.col("_a").alias("tool_calls"))
    tool = lambda t: F.struct(t["name"].alias("name"), F.coalesce(t["description"], F.lit("")).alias("description"), T.convert_flat_tool(t["parameters"], True).alias("parameters"))
    return rows.select(F.col("id").cast("string").alias("query_id"), F.array(user, turn).alias("messages"), F.transform(tools, tool).alias("tools"), F.size("_a").alias("n_answers"))
