"""Queries cover every row and whole texts: brute force in Python."""

import random
import re
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnlake.functions import render as R
from turnlake.functions import seq
from turnlake.functions import text as T
from turnlake.operators import bench, clean
from turnlake.plans import proxies

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^ \t\n\r\f\x0b]+", text or "")


def documents(spark):
    return {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_name_args_cut_of_all_events(spark):
    sf = "/root/testdata/sf0.01"  # more than 2,000 events
    want = set()
    for r in proxies.calls(spark, sf).select("event_id", "call").collect():
        n_name = r.call.index('"arguments"') // 4
        want.add((r.event_id, n_name, -(-len(r.call) // 4) - n_name))
    got = [(r.span, r.n_name, r.n_args) for r in entry.queries()["q27_name_args_cut"](spark, sf).collect()]
    assert len(got) == len(want) > 2000 and set(got) == want


def proposal(ws, k, max_n, min_n, pad):
    for n in range(min(max_n, len(ws)), min_n - 1, -1):
        for at in range(len(ws) - n):
            if ws[at : at + n] == ws[len(ws) - n :]:
                return ws[at + n : at + n + k]
    return [pad]


def test_ngram_lookup_of_whole_texts(spark):
    want = {i: proposal([w.lower() for w in ws], 3, 3, 1, "<pad>") for i, ws in documents(spark).items()}
    got = {r.doc_id: (r.n, r.proposal) for r in entry.queries()["q28_ngram_lookup"](spark, SF).collect()}
    assert got == {i: (len(p), " ".join(p)) for i, p in want.items()} and any(p != ["<pad>"] for p in want.values())


def test_ngram_propose_of_short_and_repeated(spark):
    rows = [(i, [(i * j * j + j // 3) % 3 for j in range(i)]) for i in range(12)] + [(50, [4] * 9), (51, None)]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    for max_n, min_n in ((3, 1), (3, 2), (1, 1), (4, 3)):
        got = {r.i: r.p for r in df.select("i", seq.ngram_propose(F.col("v"), F.lit(3), max_n, min_n, 9).alias("p")).collect()}
        assert got == {i: proposal(v or [], 3, max_n, min_n, 9) for i, v in rows}, (max_n, min_n)


def test_token_regions_of_whole_texts(spark):
    want = set()
    for i, ws in documents(spark).items():
        region = [3 if p in (9, 29, 30) else 2 if 10 <= p <= 28 else 1 for p in range(len(ws))]
        for code in set(region):
            at = [p for p, r in enumerate(region) if r == code]
            want.add((i, code, len(at), at[0], at[-1]))
    got = [(r.doc_id, r.region, r.n, r["first"], r["last"]) for r in entry.queries()["q08_token_regions"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(last > 50 for *_, last in want) and any(n < 40 for n in map(len, documents(spark).values()))


def test_offsets_of_any_length(spark):
    rows = [(n, [(i * 7) % 5 + 1 for i in range(n)]) for n in (0, 1, seq.RUN - 1, seq.RUN, seq.RUN + 1, 5 * seq.RUN)]
    for n, got in spark.createDataFrame(rows, "n int, v array<int>").select("n", seq.offsets(F.col("v"))).collect():
        ends = [sum(rows_v[: i + 1]) for rows_v in [dict(rows)[n]] for i in range(n)]
        assert [(x.s, x.e) for x in got] == list(zip([0, *ends], ends)), n


def one_round(proposal, preds, budget, eos):
    """A round by its definition: the longest agreeing prefix, then the verifier's token if there is room."""
    n = next((i for i, (x, y) in enumerate(zip(proposal, preds)) if x != y), len(proposal))
    if n < len(proposal):
        return [True] * n + [False], preds[n], "reject", preds[n] == eos
    if proposal[-1] == eos:
        return [True] * n, None, "full_eos", True
    if budget <= n:
        return [True] * n, None, "budget", True
    return [True] * n, preds[n], "full_eos" if preds[n] == eos else "full_bonus", preds[n] == eos


def test_rounds_equal_their_definition(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        p = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))]
        rows.append((i, p, [x if rng.random() < 0.8 else rng.randrange(1, 4) for x in [*p, rng.randrange(1, 4)]], rng.randrange(1, 7)))
    df = spark.createDataFrame(rows, "i int, p array<int>, q array<int>, b int")
    got = {r.i: (list(r.r.mask), r.r.correction, r.r.step_type, r.r.eos) for r in df.select("i", seq.verify_round(F.col("p"), F.col("q"), F.col("b"), 1).alias("r")).collect()}
    assert got == {i: one_round(p, q, b, 1) for i, p, q, b in rows}


def test_round_loop_of_whole_texts(spark):
    w = F.transform(proxies.words(), lambda w: F.abs(F.xxhash64(F.lower(w)) % 50).cast("int") + 2)
    docs = {str(r.doc_id): list(r.w or []) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", w.alias("w")).collect()}
    want = set()
    for i, ids in docs.items():
        prompt, target, out, step = ids[:-64], ids[-64:], [], 0
        while len(out) < 64:
            left = 64 - len(out)
            p = proposal(prompt + out, min(5, left), 3, 1, 0)
            preds = [target[j] if j < len(target) else 1 for j in range(len(out), len(out) + len(p) + 1)]
            mask, fix, kind, end = one_round(p, preds, left, 1)
            want.add((i, step, len(mask), sum(mask), kind))
            out, step = out + p[: sum(mask)] + ([] if fix is None else [fix]), step + 1
            if end:
                break
    got = [(r.query_id, r.step, r.n, r.n_accepted, r.step_type) for r in entry.queries()["q42_round_loop"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and {x[0] for x in got} == set(docs)


def test_numbers_of_wide_rows_under_forced_coalescing(spark):
    """Every row keeps one number, however Spark deals and coalesces its partitions."""
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    wide = spark.range(120_000, numPartitions=16).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("wide"))
    try:
        for size, parallel in (("2m", "false"), ("64m", "false"), ("64m", "true")):
            for k, v in zip(keys, (size, "1k", parallel, "64")):
                spark.conf.set(k, v)
            got = bench.chunked(wide, "k", 1000)
            r = got.agg(F.count("*").alias("n"), F.countDistinct("chunk", "place").alias("d"), F.max("chunk").alias("c"), F.max("place").alias("p"), F.min("place").alias("m")).first()
            assert tuple(r) == (120_000, 120_000, 119, 999, 0)
            w = got.select((F.col("chunk") * 1000 + F.col("place")).alias("at"), "k")
            assert w.join(w.select((F.col("at") + 1).alias("at"), F.col("k").alias("b")), "at").where("k <= b").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_numbers_of_few_null_and_equal_keys(spark):
    rows = spark.createDataFrame([("b",), (None,), ("a",), ("b",), (None,)], "k string")
    assert [r.k for r in bench.numbered(rows, "k").orderBy("at").collect()] == [None, None, "a", "b", "b"]
    assert bench.numbered(rows.where("false"), "k").count() == 0
    assert sorted(r.at for r in bench.numbered(spark.range(5), "id").collect()) == list(range(5))


def test_hundred_thousands_of_spans_take_seconds(spark):
    n = 400_000
    t = time.time()
    text = spark.range(1).select(F.repeat(F.lit("ab<c>xyz</c>"), n).alias("t"))
    r = text.select(T.payload_spans(F.col("t"), "<c>", "</c>").alias("p")).select(F.size("p").alias("n"), F.get("p", F.lit(n - 1)).alias("last"), F.size(T.outermost(F.col("p"))).alias("o")).first()
    assert r.n == r.o == n and tuple(r["last"]) == (12 * n - 7, 12 * n - 4)
    tags = text.select(R.tag_spans(F.col("t"), "<c>").alias("p")).select(F.size("p").alias("n"), F.get("p", F.lit(n - 1)).alias("last")).first()
    assert tags.n == n and tuple(tags["last"]) == (12 * n - 10, 12 * n - 7)
    assert time.time() - t < 60


def test_outermost_equals_all_pairs(spark):
    rng = random.Random(6)
    lists = [[(a, a + rng.randrange(1, 9)) for a in (rng.randrange(12) for _ in range(rng.randrange(9)))] for _ in range(300)] + [[(i, i + 200 - i % 7) for i in range(150)]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<struct<s: int, e: int>>")
    for r in rows.select("x", T.outermost(F.col("x")).alias("o")).collect():
        x = [tuple(v) for v in r.x]
        assert [tuple(v) for v in r.o] == sorted(v for v in x if not any(y != v and y[0] <= v[0] and v[1] <= y[1] for y in x))


def test_touched_runs_equal_places(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        runs = [(rng.randrange(4), rng.randrange(0, 5)) for _ in range(rng.randrange(0, 30))]
        s = rng.randrange(0, 60)
        rows.append((i, runs, s, s + rng.randrange(1, 12)))
    df = spark.createDataFrame(rows, "i int, runs array<struct<code: int, len: int>>, s int, e int")
    for r in df.select("i", seq.touched(seq.run_ends(F.col("runs")), F.col("s"), F.col("e")).alias("t")).collect():
        _, runs, s, e = rows[r.i]
        places = [c for c, n in runs for _ in range(n)]
        got = [c for c, a, b in r.t for _ in range(max(a, s), min(b, e))]
        assert got == [places[p] if p < len(places) else 1 for p in range(s, e)], rows[r.i]


def test_filtered_grams_change_nothing(spark):
    q, d = spark.read.parquet(f"{SF}/benchmark.parquet"), spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    a, b = (sorted(map(tuple, clean.contamination(q, d, most=m).collect())) for m in (10**9, 0))
    assert a == b and a
    assert clean.contamination(q.limit(0), d).count() == 0
