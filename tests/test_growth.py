"""Work that is done once, whatever the size: no expression is made anew by a filter or a second job."""

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from turnlake.functions import literals, seq
from turnlake.operators import assemble, metrics, reporting, training
from turnlake.plans import proxies


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_teacher_rows_make_no_filter_and_texts_are_cut_once(spark):
    d = spark.createDataFrame([(i, "a bb ccc " * i) for i in range(1, 9)], "ord long, text string")
    placed = training.greedy_packs(d.select("ord", F.size(proxies.words()).alias("n")), 12)
    assert optimized(placed).count("regexp_extract_all") == 1
    row = lambda n: F.array(F.struct(n.alias("id"), F.lit(-1.0).alias("lp")))
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    ids = F.transform(proxies.words(), F.length)
    rows = d.select(F.col("ord").alias("query_id"), F.array(F.lit(7)).alias("prompt_ids"), ids.alias("gen_ids"), ids.alias("lengths"), none.alias("calls"), none.alias("tags"), F.transform(ids, row).alias("logprobs"))
    records = reporting.teacher_rows(assemble.kd_records(rows))
    assert "Filter" not in optimized(records)
    assert all([[tuple(x) for x in t] for t in r.teacher] == [[(n, -1.0)] for n in r.gen_ids] for r in records.collect())


def test_proposals_equal_the_search(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1, 2, 3, None]) for _ in range(rng.randrange(12))], [rng.randrange(1, 4) for _ in range(rng.randrange(8))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p array<int>, t array<int>")
    got = df.select("i", "p", "t", training.proposals(F.col("p"), F.col("t"), 3).alias("g"))
    want = F.transform(F.sequence(F.lit(0), F.size("t")), lambda n: seq.ngram_propose(F.concat("p", F.slice("t", F.lit(1), n)), F.lit(3)))
    assert got.where(~F.col("g").eqNullSafe(want)).count() == 0 and got.count() == 300


def test_rounds_are_played_once(spark):
    rows = spark.createDataFrame([("a", [1, 2, 3], [2, 3, 1]), ("b", [], [])], "query_id string, prompt_ids array<int>, target_ids array<int>")
    events = training.simulate(rows, 2, 4, 1)
    assert optimized(events).count("aggregate(") == 1 and {r.query_id for r in events.collect()} == {"a", "b"}


def test_drop_reasons_find_problems_once(spark):
    v = spark.createDataFrame([("x: 1|y 'q'",), ("",), ("x: 2",)], "t string").select(F.filter(F.split("t", "[|]"), lambda p: p != "").alias("problems"))
    reasons = assemble.drop_reasons(v)
    assert optimized(reasons).count("filter(") == 1 and {tuple(r) for r in reasons.collect()} == {("x", 2), ("y", 1)}


def test_repeated_texts_are_read_once():
    seen, known = [], {}
    read = lambda t: (seen.append(t), json.loads(t))[1]
    assert [literals._apply(read, t, known) for t in (["[1]", "{bad"], ["[1]", None, "{bad"], None)] == [[[1], None], [[1], None, None], None]
    assert seen == ["[1]", "{bad"]


def test_grouped_leaves_draw_as_single_ones(spark):
    """Groups of leaves, whose path is walked once, give the sums that the leaves' own shares and hashes give."""
    n, n_boot = 128 * 33, 12
    values = [(i * 37) % 101 / 100 for i in range(n)]
    prompts = spark.createDataFrame([(f"q{i:05}", v) for i, v in enumerate(values)], "query_id string, alpha double")
    depth = (-(-n // metrics.LEAF) - 1).bit_length()
    shares = spark.range(1 << depth).withColumnRenamed("id", "leaf").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("m", metrics._share(n, depth, 42))
    leaves, means = {}, [0] * n_boot
    for i, v in enumerate(values):
        leaves.setdefault((i << depth) // n, []).append(round(v * 1e6))
    for leaf, b, m in shares.collect():
        for i in range(m):
            digest = hashlib.md5(f"42:{b}:d{leaf}:{i // 4}".encode()).hexdigest()
            means[b] += leaves[leaf][int(digest[7 * (i % 4) : 7 * (i % 4) + 7], 16) % len(leaves[leaf])]
    lo, hi = np.percentile([x / n / 1e6 for x in means], [2.5, 97.5])
    r = metrics.bootstrap_ci(prompts, "alpha", n_boot).first()
    assert abs(r.lo - lo) < 1e-12 and abs(r.hi - hi) < 1e-12
    assert depth - (4 * 4 - 1).bit_length() == 2


def test_prompts_are_written_once(spark):
    """Neither numbers nor draws go back to what the prompts are made of."""
    p = spark.range(1000).select(F.col("id").cast("string").alias("query_id"), F.sha2(F.col("id").cast("string"), 256).substr(1, 1).try_cast("double").alias("alpha"))
    assert "sha2" not in optimized(metrics.bootstrap_ci(p, "alpha", 5))
