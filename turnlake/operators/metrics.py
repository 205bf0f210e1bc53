"""Acceptance metrics over verification events (schemas.EVENT)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import seq
from turnlake.llm.common import bounded_batches, materialize
from turnlake.operators import bench
from turnlake.schemas import REGION_TOOL_CALL, SUB_ARGS, SUB_NAME


def event_stats(events: DataFrame) -> DataFrame:
    """events plus accepted, scored, bonus and emitted; an acceptance after a rejection is an error."""
    first_no = F.array_position("accept_mask", F.lit(False)).cast("int")
    n = F.size("accept_mask")
    run = F.when(first_no > 0, first_no - 1).otherwise(n)
    late = F.size(F.filter("accept_mask", lambda x: x)) != run
    checked = F.when(late, F.raise_error(F.concat(F.lit("mask has an acceptance behind a rejection: "), F.col("query_id"), F.lit("/"), F.col("step").cast("string"))).cast("int")).otherwise(run)
    out = events.withColumn("accepted", checked.cast("bigint"))
    bonus = F.col("correction_token").isNotNull().cast("bigint")
    return out.withColumns({"scored": F.col("accepted") + (F.col("accepted") < n).cast("bigint"), "bonus": bonus, "emitted": F.col("accepted") + bonus})


def validated(events: DataFrame) -> DataFrame:
    """Fail on events that break the schema's rules: parallel, non-empty lists without nulls."""
    ok = (F.size("draft_tokens") > 0) & (F.size("draft_tokens") == F.size("accept_mask")) & ~F.exists("accept_mask", lambda x: x.isNull()) & F.col("query_id").isNotNull() & F.col("step").isNotNull()
    return events.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("malformed event")).cast("boolean")))


def flat_metrics(stats: DataFrame) -> DataFrame:
    """One row: counts, pooled alpha, tau, bonus rate, emitted tokens. Rates are 0 without events."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    a = stats.agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("query_id").alias("n_prompts"), s("accepted").alias("a"), s("scored").alias("s"), s("bonus").alias("b"), s("emitted").alias("tokens_emitted"))
    rate = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(y)), F.lit(0.0))
    return a.select("n_events", "n_prompts", rate("a", "s").alias("alpha"), rate("a", "n_events").alias("tau"), rate("b", "n_events").alias("bonus_rate"), "tokens_emitted")


def first_step_alpha(stats: DataFrame) -> DataFrame:
    """Acceptance at place 0 of each prompt's step 0."""
    return stats.where("step = 0").agg(F.count(F.lit(1)).alias("n_prompts"), F.coalesce(F.sum((F.col("accepted") > 0).cast("bigint")), F.lit(0)).alias("n_accepted")).withColumn("alpha0", F.try_divide("n_accepted", "n_prompts"))


def alpha_by_position(stats: DataFrame, k_max: int | None = None) -> DataFrame:
    """pos, pos_scored, pos_accepted, alpha_n (null if nothing was scored); k_max cuts the table only."""
    at = stats.select("accepted", F.posexplode("accept_mask").alias("pos", "ok"))
    scored = (F.col("pos") <= F.col("accepted")).cast("bigint")
    out = at.groupBy("pos").agg(F.sum(scored).alias("pos_scored"), F.sum(scored * F.col("ok").cast("bigint")).alias("pos_accepted"))
    out = out.withColumn("alpha_n", F.try_divide("pos_accepted", "pos_scored"))
    return out if k_max is None else out.where(F.col("pos") < k_max)


def phase_timing(events: DataFrame) -> DataFrame:
    """Mean and median ms per phase and the draft's share; no row unless both are timed equally often."""
    t = events.agg(
        F.count("propose_ms").alias("n_timed"), F.count("verify_ms").alias("n_verify"),
        F.avg("propose_ms").alias("propose_ms_mean"), F.percentile("propose_ms", 0.5).alias("propose_ms_median"),
        F.avg("verify_ms").alias("verify_ms_mean"), F.percentile("verify_ms", 0.5).alias("verify_ms_median"),
        F.try_divide(F.sum("propose_ms"), F.sum("propose_ms") + F.sum("verify_ms")).alias("draft_time_share"),
    )
    return t.where("n_timed > 0 and n_timed = n_verify").drop("n_verify")


def per_prompt(stats: DataFrame, *also: str) -> DataFrame:
    """Counts and rates of each prompt; also: further keys."""
    out = stats.groupBy("query_id", *also).agg(F.count(F.lit(1)).alias("n_steps"), F.sum("scored").alias("n_scored"), F.sum("accepted").alias("n_accepted"), F.sum("emitted").alias("n_emitted"))
    return out.select("query_id", *also, "n_steps", "n_scored", "n_accepted", F.try_divide("n_accepted", "n_scored").alias("alpha"), F.try_divide("n_accepted", "n_steps").alias("tau"), "n_emitted")


def with_cursor(stats: DataFrame, records: DataFrame) -> DataFrame:
    """stats joined with records (query_id, regions RLE, labels, n_prompt_tokens) plus runs (the
    regions' codes with their ends) and cursor: the output place where a step begins. With turns,
    it restarts at each turn's start, and at the record's end for turns that the record does not
    have. A missing record is an error."""
    r = records.select("query_id", seq.run_ends(F.col("regions")).alias("runs"), seq.turn_starts(F.col("labels")).alias("starts"), "n_prompt_tokens")
    w = Window.partitionBy("query_id", "turn").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = stats.withColumn("before", F.coalesce(F.sum("emitted").over(w), F.lit(0)))
    missing = F.raise_error(F.lit("event without a record")).cast("array<struct<code: int, e: int>>")
    j = before.join(r, "query_id", "left").withColumn("runs", F.when(F.col("runs").isNull(), missing).otherwise(F.col("runs")))
    last = F.coalesce(F.try_element_at("runs", F.lit(-1))["e"], F.lit(0))
    start = F.when(F.col("turn").isNull(), F.col("n_prompt_tokens")).otherwise(F.coalesce(F.get("starts", F.col("turn")), last))
    return j.withColumn("cursor", (start + F.col("before")).cast("int")).drop("before", "starts")


def region_metrics(placed: DataFrame) -> DataFrame:
    """Per region: alpha and counts of verified, accepted and proposed by place of proposal, emitted
    by output place. An event is one row per run that it touches: each count is the overlap of
    the run with the first places that count (verified up to the first rejection)."""
    n, accepted, emitted = F.size("draft_tokens"), F.col("accepted").cast("int"), F.col("emitted").cast("int")
    ends = {"n_verified": F.least(n, accepted + 1), "n_accepted": accepted, "n_proposed": n, "n_emitted": emitted}
    at = placed.select(F.explode(seq.touched(F.col("runs"), F.col("cursor"), F.col("cursor") + F.greatest(n, emitted))).alias("r"), "cursor", *(v.alias(k) for k, v in ends.items()))
    overlap = lambda to: F.greatest(F.lit(0), F.least(F.col("r.e"), F.col("cursor") + F.col(to)) - F.greatest(F.col("r.s"), F.col("cursor"))).cast("bigint")
    out = at.groupBy(F.col("r.code").alias("region")).agg(*(F.sum(overlap(k)).alias(k) for k in ends))
    return out.withColumn("alpha", F.try_divide("n_accepted", "n_verified"))


#: Prompts that a leaf of the tree of draws holds at most.
LEAF = 128


def _hex_number(digest: Column, at: Column, digits: int) -> Column:
    """Digits of a hex text, from place `at` (from 0), as a number."""
    return F.conv(F.substring(digest, at + 1, F.lit(digits)), 16, 10).cast("bigint")


def _share(n: int, depth: int, seed: int) -> Column:
    """How many of the n draws of replicate b fall into leaf `leaf` of a tree with 2^depth leaves.

    At each node on the leaf's path its draws part between its halves: a binomial number in its
    normal limit (a node above the leaves holds over LEAF prompts), the normal number being the
    sum of eight 16-bit numbers of the node's MD5. The right half takes the rest, so that the
    leaves' draws are n in all, and no leaf has to know another."""
    begin = lambda q, k: F.expr(f"({q} * {n}L + {(1 << k) - 1}L) div {1 << k}L")  # the first place of node q at level k

    def parted(m: Column, k: int) -> Column:
        """The draws of the path's node at level k, m being those of the node above."""
        above = f"shiftright(leaf, {depth - k + 1})"
        left = begin(f"(2 * {above} + 1)", k) - begin(f"(2 * {above})", k)
        p = left / (begin(f"({above} + 1)", k - 1) - begin(above, k - 1))
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.lit(f"t{k}"), F.expr(f"cast({above} as string)")))
        total = seq.let(digest, lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("bigint"), lambda a, i: a + _hex_number(h, i * 4, 4)))
        z = (total - 262140) / F.lit(65536.0) * F.lit(1.5**0.5)
        to_left = lambda x: F.least(x["m"], F.greatest(F.lit(0).cast("bigint"), F.floor(x["m"] * x["p"] + x["z"] * F.sqrt(x["m"] * x["p"] * (1 - x["p"])) + 0.5)))
        is_left = F.expr(f"shiftright(leaf, {depth - k}) % 2 = 0")
        return seq.let(F.struct(m.alias("m"), p.alias("p"), z.alias("z")), lambda x: F.when(is_left, to_left(x)).otherwise(x["m"] - to_left(x)))

    m = F.lit(n).cast("bigint")
    for k in range(1, depth + 1):
        m = parted(m, k)
    return m


def _replicates(n: int, depth: int, group: int, n_boot: int, seed: int):
    """A function of a group of 2^group leaves, as batches of (g, at, v), to one row: the sums of each
    replicate's draws with repeats from all leaves of the partition; as _share, but a node's hash is
    made once for all leaves under it. Four draws a hash."""

    def numbers(texts: list[str], digits: int, many: int) -> np.ndarray:
        """The first `many` numbers of so many hex digits of each text's MD5."""
        raw = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in texts), np.uint8).reshape(-1, 16)
        nibbles = np.stack([raw >> 4, raw & 15], 2).reshape(-1, 32)[:, : digits * many].reshape(-1, many, digits).astype(np.int64)
        return nibbles @ (16 ** np.arange(digits - 1, -1, -1))

    def begin(q: int, k: int) -> int:
        return (q * n + (1 << k) - 1) >> k

    def parted(m: np.ndarray, q: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The draws m of node q at level k - 1, for its left and right half."""
        p = (begin(2 * q + 1, k) - begin(2 * q, k)) / (begin(q + 1, k - 1) - begin(q, k - 1))
        total = numbers([f"{seed}:{b}:t{k}:{q}" for b in range(n_boot)], 4, 8).sum(1)
        z = (total - 262140) / 65536.0 * 1.5**0.5
        x = m * p
        left = np.minimum(m, np.maximum(0, np.floor(x + z * np.sqrt(x * (1 - p)) + 0.5).astype(np.int64)))
        return left, m - left

    def drawn(m: np.ndarray, leaf: int, values: np.ndarray) -> np.ndarray:
        hashes = -(-m // 4)
        texts = [f"{seed}:{b}:d{leaf}:{j}" for b, h in enumerate(hashes.tolist()) for j in range(h)]
        if not texts:
            return np.zeros((n_boot, values.shape[1]), np.int64)
        at = numbers(texts, 7, 4) % len(values)
        of = np.repeat(np.arange(n_boot), hashes)
        j = np.arange(len(of)) - np.repeat(np.cumsum(hashes) - hashes, hashes)
        counts = (4 * j[:, None] + np.arange(4)) < m[of][:, None]
        before = np.zeros((len(of) + 1, values.shape[1]), np.int64)
        np.cumsum((values[at] * counts[:, :, None]).sum(1), 0, out=before[1:])
        until = np.cumsum(hashes)
        return before[until] - before[until - hashes]

    def of_group(g: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        top = depth - group
        m = np.full(n_boot, n, np.int64)
        for k in range(1, top + 1):
            m = parted(m, g >> (top - k + 1), k)[(g >> (top - k)) & 1]
        nodes = {g: m}
        for k in range(top + 1, depth + 1):
            nodes = {2 * q + side: half for q, m in nodes.items() for side, half in enumerate(parted(m, q, k))}
        order = np.argsort(at)
        at, values = at[order], values[order]
        cuts = np.searchsorted(at, [begin(q, depth) for q in nodes] + [begin(max(nodes) + 1, depth)])
        return sum(drawn(m, q, values[a:b]) for (q, m), a, b in zip(nodes.items(), cuts[:-1], cuts[1:]))

    def run(batches):
        sums = None
        for batch in batches:
            for g, rows in zip(batch.column("g").to_pylist(), batch.column("rows")):
                values = rows.values
                v = values.field("v").flatten().to_numpy(zero_copy_only=False)
                got = of_group(g, values.field("at").to_numpy(zero_copy_only=False), v.reshape(len(values), -1))
                sums = got if sums is None else sums + got
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([range(n_boot)], pa.list_(pa.int32())), pa.array([sums.tolist()], pa.list_(pa.list_(pa.int64())))], ["b", "s"])

    return run


def bootstrap_cis(prompts: DataFrame, stats: list[str], n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """95% intervals of the means of stats (null: 0) over prompts; all stats share their draws.

    Prompts in order of query_id are cut into even leaves of at most LEAF. What a replicate draws
    from a leaf follows from hashes alone (_share), so a replicate is a sum over leaves, added up
    where they lie: no draw is a row, and n_boot rows a task are shuffled. Leaves are dealt in groups
    of neighbours, whose common path is walked once. Hashes are MD5, so that other engines can
    draw the same. Up to 3 * 10^10 prompts. Writes the prompts' numbers, and runs jobs, when called."""
    if n_boot < 1:
        raise ValueError("n_boot must be >= 1")
    micro = F.array(*(F.round(F.coalesce(F.col(s), F.lit(0.0)) * 1e6).cast("bigint") for s in stats))
    values = materialize(prompts.select("query_id", micro.alias("v")))
    placed, n = bench.numbered_total(values, "query_id")
    placed = materialize(placed.select("at", "v"))
    depth = (-(-n // LEAF) - 1).bit_length() if n else 0
    tasks = int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: leaves are small, their draws are not
    group = max(0, min(6, depth - (4 * tasks - 1).bit_length()))  # four groups a task where there are so many leaves
    g = F.expr(f"shiftleft(cast(at as bigint), {depth}) div {max(n, 1)}L >> {group}")
    groups = placed.withColumn("g", g).repartition(tasks, "g").groupBy("g").agg(F.collect_list(F.struct("at", "v")).alias("rows"))
    bounded_batches(prompts.sparkSession)
    work = _replicates(n, depth, group, n_boot, seed)
    sums = groups.mapInArrow(work, "b array<int>, s array<array<bigint>>").select(F.explode(F.arrays_zip("b", "s")).alias("x")).select("x.b", "x.s")
    mean = lambda i, rows: F.sum(F.get(rows, F.lit(i))) / n / 1e6
    means = sums.groupBy("b").agg(*(mean(i, "s").alias(f"m{i}") for i in range(len(stats)))) if n else sums.select("b", *(F.lit(None).cast("double").alias(f"m{i}") for i in range(len(stats))))
    cuts = means.agg(*(F.percentile(f"m{i}", q).alias(f"{side}{i}") for i in range(len(stats)) for side, q in (("lo", 0.025), ("hi", 0.975))))
    truth = placed.agg(*((mean(i, "v") if n else F.sum(F.lit(None).cast("double"))).alias(f"mean{i}") for i in range(len(stats))))
    rows = [F.struct(F.lit(s).alias("stat"), F.col(f"mean{i}").alias("mean"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.lit(n).cast("bigint").alias("n_prompts")) for i, s in enumerate(stats)]
    return cuts.crossJoin(F.broadcast(truth)).select(F.inline(F.array(*rows)))  # one row each


def bootstrap_ci(prompts: DataFrame, stat: str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """bootstrap_cis of one stat."""
    return bootstrap_cis(prompts, [stat], n_boot, seed)


def bootstrap_ci_numpy(prompts: DataFrame, stat: str, n_boot: int = 1000, seed: int = 42) -> dict:
    """The interval with numpy's generator on the driver: one number per prompt is collected."""
    v = np.array([r[0] if r[0] is not None else 0.0 for r in prompts.orderBy("query_id").select(stat).collect()])
    rng = np.random.default_rng(seed)
    boots = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(n_boot)])
    return {"stat": stat, "mean": float(v.mean()), "ci95": [float(np.percentile(boots, 2.5)), float(np.percentile(boots, 97.5))], "n_prompts": len(v)}


def ci_overlap(intervals: DataFrame) -> DataFrame:
    """Pairs of runs (run, lo, hi) and whether their intervals are apart."""
    a, b = intervals.select(F.col("run").alias("run_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a")), intervals.select(F.col("run").alias("run_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", (F.greatest("lo_a", "lo_b") > F.least("hi_a", "hi_b")).alias("apart"))


def sub_regions(regions: Column, pieces: Column, key: str = '"arguments"') -> Column:
    """Region runs with each call run parted at the key: tokens that end before it are SUB_NAME, the
    rest SUB_ARGS; without the key all are SUB_NAME. pieces: the text of each token."""

    def parted(r: Column, o: Column) -> Column:
        inside = F.slice(pieces, o["s"] + 1, o["e"] - o["s"])
        cut = F.locate(key, F.array_join(inside, ""))
        before = lambda at: F.when(at == 0, o["e"] - o["s"]).otherwise(F.size(F.filter(seq.offsets(F.transform(inside, F.length)), lambda x: x["e"] < at)))
        run = lambda code, n: F.struct(F.lit(code).alias("code"), n.cast("int").alias("len"))
        both = lambda n: F.filter(F.array(run(SUB_NAME, n), run(SUB_ARGS, o["e"] - o["s"] - n)), lambda x: x["len"] > 0)
        same = F.array(F.struct(r["code"].cast("int").alias("code"), r["len"].cast("int").alias("len")))
        return F.when(r["code"] == REGION_TOOL_CALL, seq.let(seq.let(cut, before), both)).otherwise(same)

    return F.flatten(seq.let(regions, lambda v: F.zip_with(v, seq.offsets(F.transform(v, lambda r: r["len"].cast("int"))), parted)))


def name_arguments_cut(tokens: DataFrame, key: str = '"arguments"') -> DataFrame:
    """tokens (span id, pos, piece) of payload spans plus sub: name up to the key, arguments after it."""
    run = Window.partitionBy("span").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = tokens.groupBy("span").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("t"))
    whole = whole.select("span", F.locate(key, F.col("t")).alias("cut"))
    out = tokens.withColumn("end", F.sum(F.length("piece")).over(run)).join(whole, "span")
    return out.withColumn("sub", F.when((F.col("cut") == 0) | (F.col("end") <= F.col("cut") - 1), SUB_NAME).otherwise(SUB_ARGS)).drop("cut", "end")
