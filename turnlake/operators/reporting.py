"""Reports and statistics over events, data sets, carves and runs, and where a run came from."""

from __future__ import annotations

import re
import subprocess
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions import seq
from turnlake.operators import metrics
from turnlake.schemas import REGION_TAG, REGION_TOOL_CALL


def full_report(events: DataFrame, records: DataFrame | None = None, k_max: int | None = None, n_boot: int = 1000, pieces: str | None = None) -> dict:
    """flat, per position, ci and, with records, regions, as plain values; with pieces (the column
    of the records' token texts) also the cut of calls into name and arguments. per_prompt stays a
    DataFrame, as it grows with the input; all else is a few rows."""
    stats = metrics.event_stats(events)
    prompts = metrics.per_prompt(stats)
    flat = metrics.flat_metrics(stats).first().asDict()
    flat["alpha_n"] = [r.alpha_n for r in metrics.alpha_by_position(stats, k_max).orderBy("pos").collect()]
    timing = metrics.phase_timing(events).collect()
    flat |= timing[0].asDict() if timing else {}
    ci = {r.stat: {"mean": r.mean, "ci95": [r.lo, r.hi], "n_prompts": r.n_prompts} for r in metrics.bootstrap_cis(prompts, ["alpha", "tau"], n_boot).collect()}
    out = {"flat": flat, "ci": ci, "per_prompt": prompts.orderBy("query_id")}
    if records is not None:
        of = lambda recs: metrics.region_metrics(metrics.with_cursor(stats, recs)).orderBy("region").collect()
        rows = of(records)
        verified = [r for r in rows if r.n_verified]
        if pieces is not None:
            cut = [r for r in of(records.withColumn("regions", metrics.sub_regions(F.col("regions"), F.col(pieces)))) if r.n_verified]
            out |= {"subcut_alpha": {str(r.region): r.alpha for r in cut}, "subcut_n_verified": {str(r.region): r.n_verified for r in cut}}
        out |= {"region_alpha": {str(r.region): r.alpha for r in verified}, "region_n_verified": {str(r.region): r.n_verified for r in verified}, "region_n_emitted": {str(r.region): r.n_emitted for r in rows if r.n_emitted}}
    return out


def tau_pair(one: dict, two: dict) -> tuple:
    """Tau and its interval of two reports."""
    return one["flat"]["tau"], one["ci"]["tau"]["ci95"], two["flat"]["tau"], two["ci"]["tau"]["ci95"]


def dataset_stats(records: DataFrame) -> DataFrame:
    """records (n_tokens, regions) to counts, length percentiles and the share of call and tag tokens."""
    p = lambda q: F.percentile("n_tokens", q)
    in_calls = F.aggregate(F.filter("regions", lambda r: r["code"].isin(REGION_TOOL_CALL, REGION_TAG)), F.lit(0).cast("bigint"), lambda a, r: a + r["len"])
    total = F.sum("n_tokens")
    return records.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit(0)).cast("bigint").alias("tokens_total"), p(0.5).alias("n_tokens_median"), p(0.95).alias("n_tokens_p95"), F.max("n_tokens").cast("bigint").alias("n_tokens_max"),
        F.round(F.try_divide(100 * F.sum(in_calls), total), 1).alias("pct_tool_call"),
    )


def carve_stats(carve: dict[str, DataFrame], uses: DataFrame) -> DataFrame:
    """One row of counts of a rarity carve over uses (example, tool)."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(uses.select("example").distinct(), "n_examples")
    for name, df in (("eval_size", carve["eval"]), ("heldout_tools", carve["heldout"]), ("pool", carve["pool"])):
        out = out.crossJoin(F.broadcast(n(df, name)))  # one row each
    return out.withColumn("pool_pct", F.round(F.try_divide(100 * F.col("pool"), F.col("n_examples")), 1))


def run_totals(outputs: DataFrame, wall_s: float) -> DataFrame:
    """outputs (output_ids) to counts of prompts and tokens beside the wall time."""
    return outputs.agg(F.count(F.lit(1)).alias("n_prompts"), F.coalesce(F.sum(F.size("output_ids")), F.lit(0)).cast("bigint").alias("n_tokens"), F.lit(round(wall_s, 2)).alias("wall_s"))


def teacher_rows(records: DataFrame) -> DataFrame:
    """records (labels, gen_logprob_token_ids, gen_logprob_values) plus teacher: one row of
    (id, lp) per label, null where there was none. Another number of rows than of labels, or a
    label at place 0, whose predictor would lie outside the record, is an error of the column: a
    filter would be pushed below what makes the arrays and make them anew for itself."""
    n = F.size(F.filter("labels", lambda x: x != -100))
    fits = seq.let(n, lambda n: (F.size("gen_logprob_token_ids") == n) & (F.size("gen_logprob_values") == n))
    row = lambda ids, lps: F.when(F.size(ids) > 0, F.arrays_zip(ids.alias("id"), lps.alias("lp")))
    wrong = F.when(~F.coalesce(fits, F.lit(False)), F.lit("teacher rows and labels differ in number")).when(F.get("labels", F.lit(0)) != -100, F.lit("a label stands at place 0"))
    kind = lambda c: records.schema[c].dataType.elementType.elementType.simpleString()
    error = F.raise_error(wrong).cast(f"array<array<struct<id: {kind('gen_logprob_token_ids')}, lp: {kind('gen_logprob_values')}>>>")
    return records.withColumn("teacher", F.when(wrong.isNotNull(), error).otherwise(F.zip_with("gen_logprob_token_ids", "gen_logprob_values", row)))


def batch_arrays(packs: DataFrame, width: int, *also: str) -> DataFrame:
    """packs (pack, input_ids, loss_positions, teacher) to rectangles: ids and lps of each label
    padded to width (0, -inf), whether it has a teacher, its label, and keep: the logits row
    before it. also: further columns to keep."""
    padding = lambda zero: F.array(*[zero] * width)
    pad = lambda part, zero: F.transform("teacher", lambda r: F.coalesce(F.slice(F.concat(r[part], padding(zero)), 1, width), padding(zero)))
    label = seq.let(F.col("input_ids"), lambda ids: F.transform("loss_positions", lambda p: F.get(ids, p)))
    return packs.select(
        "pack", pad("id", F.lit(0)).alias("teacher_ids"), pad("lp", F.lit(float("-inf"))).alias("teacher_lps"), F.transform("teacher", lambda r: F.coalesce(F.size(r) > 0, F.lit(False))).alias("valid"),
        label.alias("labels"), F.sort_array(F.transform("loss_positions", lambda p: p - 1)).alias("keep"), *also,
    )


def dereference(positions: DataFrame, index: DataFrame) -> DataFrame:
    """positions (ord, idx) into index (ord, raw_idx) to (ord, raw_idx); a place outside is an error."""
    at = index.select(F.col("ord").alias("idx"), "raw_idx")
    j = positions.select("ord", "idx").join(at, "idx", "left")
    return j.select("ord", F.when(F.col("raw_idx").isNull(), F.raise_error(F.lit("a position outside the index")).cast("bigint")).otherwise(F.col("raw_idx")).alias("raw_idx"))


def gather(raw: DataFrame, places: DataFrame, key: str = "raw_idx") -> DataFrame:
    """The rows of raw at places (ord, raw_idx), with ord; a place that raw lacks is an error."""
    j = places.join(raw.withColumn("_there", F.lit(True)), key, "left")
    return j.where(F.when(F.col("_there").isNull(), F.raise_error(F.lit("raw rows are missing")).cast("boolean")).otherwise(F.lit(True))).drop("_there")


def with_generations(contexts: DataFrame, generations: DataFrame) -> DataFrame:
    """contexts joined with their generations by query_id; a context without one is an error."""
    j = contexts.join(generations.withColumn("_there", F.lit(True)), "query_id", "left")
    return j.where(F.when(F.col("_there").isNull(), F.raise_error(F.lit("a context without a generation")).cast("boolean")).otherwise(F.lit(True))).drop("_there")


def keep_exact(verdicts: DataFrame) -> DataFrame:
    """Rows that are valid and whose tokens make up their text again."""
    return verdicts.where(F.col("valid") & F.col("roundtrip_exact"))


def finish_reason(engine: Column) -> Column:
    """An engine's reason: length, or else stop."""
    return F.when(engine == "length", "length").otherwise("stop")


def temperature(text: str) -> float:
    """"greedy" or a number that is not negative."""
    value = 0.0 if text == "greedy" else float(text)
    if not value >= 0:
        raise ValueError(f"temperature {text!r} is below 0")
    return value


def call_tags(rendered: str, header: str, end: str) -> tuple[str, str]:
    """The words before and behind the JSON object of the last assistant turn in a probe's rendering."""
    turn = rendered.rpartition(header)[2].partition(end)[0]
    around = re.search(r"(\S+)\s+\{.*\}\s+(\S+)", turn, re.S)
    if not around or around[1] == around[2]:
        raise ValueError(f"no pair of tags around the probe's call: {turn!r}")
    return around[1], around[2]


def provenance(folder: str = ".") -> dict[str, str | None]:
    """The time and the commit of the code in folder (null outside a work tree)."""
    got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return {"ts": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "commit": got.stdout.strip() if got.returncode == 0 else None}
