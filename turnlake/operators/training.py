"""Packing in record order, slot plans, and the round loop."""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from turnlake.functions import seq
from turnlake.llm.common import bounded_batches, materialize
from turnlake.schemas import NO_LOSS


def _break_table(n, cap: int):
    """How a run of lengths acts on a pack with `used` tokens: if it first breaks at record k
    (used + sum before k fits, with k it does not), it opens packs[k] packs and the last holds
    tail[k]. Only records that some used in 0..cap can break at are listed, with the sum through k."""
    cum = np.concatenate([[0], np.cumsum(n)])
    nxt = np.searchsorted(cum, cum[:-1] + cap, side="right") - 1  # a pack that starts at i ends before nxt[i]
    packs, tail = np.ones(len(n), np.int64), cum[-1] - cum[:-1]
    for i in range(len(n) - 1, -1, -1):
        if nxt[i] < len(n):
            packs[i], tail[i] = packs[nxt[i]] + 1, tail[nxt[i]]
    some = np.flatnonzero(cum[:-1] <= cap)
    return some, cum[1:][some], packs[some], tail[some], int(cum[-1])


def greedy_packs(sized: DataFrame, cap: int, order: str = "ord", length: str = "n", rows_per_part: int = 1_000_000) -> DataFrame:
    """Sequential packing in record order: a record that no longer fits starts the next pack;
    records longer than cap are skipped. Adds pack (from 0) and offset.

    Ranges of the order are folded apart: each reports how it acts on any fill of the pack it
    is entered with (where it first breaks decides the rest), the driver chains these short
    tables, and each range then places its records from its own entry. The lengths are written
    once: four jobs read them, and texts behind them would be cut into words for each."""
    fits = materialize(sized.select(F.col(order).alias("o"), F.col(length).cast("bigint").alias("n"))).where(F.col("n") <= cap)
    parts = max(1, -(-fits.count() // rows_per_part))
    bounds = sorted(set(fits.approxQuantile("o", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.lit(bounds), lambda b: F.col("o") > b)) if bounds else F.lit(0)
    ranged = fits.withColumn("part", part.cast("bigint"))

    def act(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        _, through, packs, tail, total = _break_table(f.sort_values("o")["n"].to_numpy(), cap)
        return pd.DataFrame([(int(key[0]), through.tolist(), packs.tolist(), tail.tolist(), total)], columns=["part", "through", "packs", "tail", "total"])

    acts = ranged.groupBy("part").applyInPandas(act, "part bigint, through array<bigint>, packs array<bigint>, tail array<bigint>, total bigint").orderBy("part").collect()
    entry, pack, used = {}, 0, 0
    for r in acts:
        entry[r.part] = (pack, used)
        k = next((k for k, t in enumerate(r.through) if used + t > cap), None)
        pack, used = (pack, used + r.total) if k is None else (pack + r.packs[k], r.tail[k])

    def place(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        pack, used = entry[int(key[0])]
        f = f.sort_values("o")
        packs, offs = [], []
        for n in f["n"].tolist():
            if used and used + n > cap:
                pack, used = pack + 1, 0
            packs.append(pack)
            offs.append(used)
            used += n
        return pd.DataFrame({"o": f["o"], "pack": packs, "offset": offs})

    placed = ranged.groupBy("part").applyInPandas(place, "o bigint, pack bigint, offset bigint")
    return sized.join(placed, sized[order] == placed["o"]).drop("o")


def pack_arrays(placed: DataFrame, order: str = "ord") -> DataFrame:
    """placed (query_id, input_ids, labels, pack, offset and, if there, teacher: a row per label) to
    packs with restarted positions, loss places and their teacher rows. A label at place 0 of a
    record is an error: its predictor would be another record's. A pack holds at most the cap's tokens."""
    teacher = ["teacher"] if "teacher" in placed.columns else []
    at_start = F.raise_error(F.concat(F.lit("a label stands at place 0 of "), F.coalesce(F.col("query_id").cast("string"), F.lit("a record without id")))).cast("array<int>")
    labels = F.when(F.get("labels", F.lit(0)) != NO_LOSS, at_start).otherwise(F.col("labels")).alias("labels")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "query_id", "input_ids", labels, "offset", *teacher)))
    p = placed.groupBy("pack").agg(rows.alias("r"))
    places = F.flatten(F.transform("r", lambda x: seq.let(x["labels"], lambda v: F.transform(F.filter(seq.indices(v), lambda i: F.get(v, i) != NO_LOSS), lambda i: i + x["offset"].cast("int")))))
    return p.select(
        "pack", F.flatten(F.col("r.input_ids")).alias("input_ids"), F.flatten(F.transform("r", lambda x: seq.indices(x["input_ids"]))).alias("position_ids"),
        places.alias("loss_positions"), F.col("r.query_id").alias("record_ids"), F.size("r").alias("n_records"), *(F.flatten(F.col(f"r.{t}")).alias(t) for t in teacher),
    )


def label_share(placed: DataFrame) -> DataFrame:
    """One row: n_label_tokens and their share of the packed tokens (null without tokens)."""
    n = F.coalesce(F.sum(F.size(F.filter("labels", lambda x: x != NO_LOSS))), F.lit(0)).cast("bigint")
    return placed.agg(n.alias("n_label_tokens"), F.round(F.try_divide(n, F.sum(F.size("input_ids"))), 4).alias("label_share"))


def pack_stats(placed: DataFrame, skipped: DataFrame) -> DataFrame:
    per = placed.groupBy("pack").agg(F.sum("n").alias("len"), F.count(F.lit(1)).alias("records"))
    s = per.agg(F.count(F.lit(1)).alias("n_packs"), F.percentile("len", 0.5).alias("median_len"), F.max("len").cast("bigint").alias("max_len"), F.percentile("records", 0.5).alias("median_records"))
    return s.crossJoin(F.broadcast(skipped.agg(F.count(F.lit(1)).alias("n_skipped"))))


def teacher_width(rows: DataFrame, cap: int = 20) -> DataFrame:
    """rows (teacher array) to the padded width: the longest, at most cap, at least 1."""
    return rows.agg(F.greatest(F.lit(1), F.coalesce(F.max(F.least(F.size("teacher"), F.lit(cap))), F.lit(1))).alias("width"))


def mix_plan(spark, n: int, share: float) -> DataFrame:
    """slot and whether it is a minority one: every K-th, K = max(2, round(1/share)); share in [0, 0.5)."""
    if not 0 <= share < 0.5:
        raise ValueError("share must be in [0, 0.5)")
    k = max(2, round(1 / share)) if share else 0
    return spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") + 1) % k == 0).alias("minor") if k else F.lit(False).alias("minor"))


def cyclic(df: DataFrame, items: DataFrame, at: str, order: str) -> DataFrame:
    """df joined with items by pmod(at, number of items), in items' order. items is small."""
    n = items.count()
    numbered = items.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    return df.withColumn("_i", F.pmod(F.col(at), F.lit(n)).cast("int")).join(numbered, "_i").drop("_i")


def _proposals(prompts: pa.Array, targets: pa.Array, k: int, pad: int) -> pa.Array:
    """Of each text (a prompt and its target) and each number n of target tokens that may be out, from 0 to
    all: what seq.ngram_propose finds in the text so far, the k followers of the earliest earlier
    occurrence of the longest suffix (3 tokens at most), or pad.

    An n-gram's number is the place where it first ends, so longer ones are pairs of numbers."""
    texts = [a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (prompts, targets)]
    size, total = texts[0] + texts[1], int(texts[0].sum() + texts[1].sum())
    start = np.cumsum(size) - size
    tokens = np.empty(total, np.int64)
    for a, n, at in zip((prompts, targets), texts, (start, start + texts[0]), strict=True):
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        tokens[np.repeat(at, n) + within] = a.flatten().cast(pa.int64()).fill_null(1 << 31).to_numpy(zero_copy_only=False)

    def first(left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
        _, at, number = np.unique(left * most + right, return_index=True, return_inverse=True)
        return at[number]

    here = np.arange(total)
    before = lambda x: np.r_[total, x[:-1]][:total]
    one = first(np.repeat(np.arange(len(size)), size), tokens + (1 << 31), (1 << 32) + 1)
    two = first(before(one), one, total + 1)
    three = first(before(two), one, total + 1)
    found = np.where(three < here, three, np.where(two < here, two, np.where(one < here, one, -1)))
    n = texts[1] + 1
    ends = np.cumsum(n)
    place = np.repeat(start + texts[0] - 1, n) + np.arange(n.sum()) - np.repeat(ends - n, n)
    found = np.where(place < np.repeat(start, n), -1, np.r_[found, -1][place])
    many = np.where(found < 0, 1, np.minimum(k, place - found))
    until = np.cumsum(many)
    at = np.repeat(found + 1, many) + np.arange(many.sum()) - np.repeat(until - many, many)
    value = np.where(np.repeat(found < 0, many), pad, np.r_[tokens, pad][at])
    inner = pa.ListArray.from_arrays(pa.array(np.r_[0, until], pa.int32()), pa.array(value, pa.int64(), mask=value == 1 << 31).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), inner)


def proposals(prompts: Column, targets: Column, k: int, pad: int = 0) -> Column:
    """array<array<int>> of _proposals; not to be repeated where it is used."""

    def run(prompts: pa.Array, targets: pa.Array) -> pa.Array:
        return _proposals(prompts, targets, k, pad)

    return arrow_udf(run, "array<array<int>>").asNondeterministic()(prompts, targets)


def simulate(rows: DataFrame, k: int, budget: int, eos: int) -> DataFrame:
    """rows (query_id, prompt_ids, target_ids) to events: proposals by n-gram lookup, verified against
    the target and the end token behind it (seq.round_events)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    bounded_batches(rows.sparkSession)  # texts can be long
    found = rows.select("query_id", "target_ids", proposals(F.col("prompt_ids"), F.col("target_ids"), k).alias("found"))
    events = seq.round_events(F.col("target_ids"), F.col("found"), k, budget, eos)
    # outer: no filter on the rounds is inferred, which would play them anew
    return found.select("query_id", F.explode_outer(events).alias("e")).where("e is not null").select("query_id", "e.*")


def simulate_turns(records: DataFrame, k: int, budget: int, eos: int) -> DataFrame:
    """Every assistant turn of records (query_id, input_ids, labels): each turn starts from the
    true tokens before it, whatever the turn before came to, and its own labelled tokens are
    the target. Events with turn; null for records of one turn."""
    r = records.select("query_id", "input_ids", "labels", seq.turn_starts(F.col("labels")).alias("starts"))
    ends = lambda s: F.coalesce(F.get(F.filter(seq.indices(F.col("labels")), lambda i: (i > s) & (F.get("labels", i) == NO_LOSS)), F.lit(0)), F.size("labels"))
    t = r.select("query_id", "input_ids", "labels", F.size("starts").alias("n"), F.posexplode("starts").alias("turn", "s"))
    t = t.withColumn("e", ends(F.col("s")))
    key = F.to_json(F.struct(F.col("query_id").alias("q"), F.when(F.col("n") > 1, F.col("turn")).alias("t")))
    rows = t.select(key.alias("query_id"), F.slice("input_ids", F.lit(1), F.col("s")).alias("prompt_ids"), F.slice("input_ids", F.col("s") + 1, F.col("e") - F.col("s")).alias("target_ids"))
    out = simulate(rows, k, budget, eos).withColumn("_k", F.from_json("query_id", "q string, t int"))
    return out.select(F.col("_k.q").alias("query_id"), F.col("_k.t").alias("turn"), *[c for c in out.columns if c not in ("query_id", "_k")])
