"""Hand-computed cases."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnlake import schemas
from turnlake.functions import losses, seq
from turnlake.functions import text as T
from turnlake.operators import assemble, bench, clean, integrity, metrics, training
from turnlake.sources import readers, writers
from turnlake.streaming import metrics_stream


def one(spark, value, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, v)
    return df.select(value.alias("x")).first().x


def ints(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<int>)")


def event(q, step, draft, mask, fix, turn=None):
    return (q, turn, step, draft, mask, fix, False, None, None, None)


EVENTS = [event("q0", 0, [10, 11, 12], [True, True, False], 99), event("q0", 1, [13, 14, 15], [True] * 3, 98), event("q0", 2, [16, 17], [True, False], 97)]
MORE = [event("q1", 0, [20], [False], 50), event("q1", 1, [21, 22], [True, True], 51)]


def stats(spark, rows):
    return metrics.event_stats(spark.createDataFrame(rows, schemas.EVENT))


def test_flat_metrics(spark):
    m = metrics.flat_metrics(stats(spark, EVENTS)).first()
    assert (m.alpha, m.tau, m.bonus_rate, m.tokens_emitted, m.n_events, m.n_prompts) == (0.75, 2.0, 1.0, 9, 3, 1)
    both = metrics.flat_metrics(stats(spark, EVENTS + MORE)).first()
    assert (both.alpha, both.tau) == (8 / 11, 8 / 5)
    at = metrics.alpha_by_position(stats(spark, EVENTS)).orderBy("pos").collect()
    assert [(r.pos_scored, r.pos_accepted) for r in at] == [(3, 3), (3, 2), (2, 1)]
    assert metrics.flat_metrics(stats(spark, [])).first().alpha == 0


def test_late_acceptance_is_an_error(spark):
    with pytest.raises(PySparkException):
        metrics.flat_metrics(stats(spark, [event("q", 0, [1, 2], [False, True], 3)])).collect()


def test_event_reader(spark, tmp_path):
    good = {"query_id": "q", "step": 0, "draft_tokens": [1], "accept_mask": [True], "correction_token": None, "eos": False}
    (tmp_path / "e.jsonl").write_text(json.dumps(good) + "\n\n")
    assert readers.events(spark, str(tmp_path / "e.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text(json.dumps(good | {"accept_mask": [True, False]}))
    with pytest.raises(PySparkException):
        readers.events(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(ValueError):
        readers.events(spark, str(tmp_path / "empty.jsonl"))


def test_regions(spark):
    record = [("q0", [(0, 4), (1, 1), (3, 1), (2, 3), (4, 1)], [-100] * 4 + [1] * 6, 4)]
    r = spark.createDataFrame(record, "query_id string, regions array<struct<code: int, len: int>>, labels array<int>, n_prompt_tokens int")
    got = {x.region: (x.alpha, x.n_verified) for x in metrics.region_metrics(metrics.with_cursor(stats(spark, [event("q0", 0, [1, 2, 3, 4, 5], [True] * 4 + [False], 9)]), r)).collect()}
    assert got == {1: (1.0, 1), 3: (1.0, 1), 2: (2 / 3, 3)}
    with pytest.raises(PySparkException):
        metrics.with_cursor(stats(spark, EVENTS), r.where("false")).collect()


def test_cursor_restarts_at_turns(spark):
    labels = [-100] * 4 + [5, 6, 7, -100, 8, 9]
    r = spark.createDataFrame([("q0", [(0, 10)], labels, 4)], "query_id string, regions array<struct<code: int, len: int>>, labels array<int>, n_prompt_tokens int")
    rows = [event("q0", 0, [1], [True], None, 0), event("q0", 1, [1], [True], 2, 0), event("q0", 0, [1], [True], 2, 1), event("q0", 0, [1], [True], 2, 7)]
    got = sorted((x.turn, x.step, x.cursor) for x in metrics.with_cursor(stats(spark, rows), r).collect())
    assert got == [(0, 0, 4), (0, 1, 5), (1, 0, 8), (7, 0, 10)]


def test_name_arguments_cut(spark):
    pieces = ['{"name": "get_weather", ', '"arguments"', ': {"city": "Paris"', "}}"]
    t = spark.createDataFrame([(0, i, p) for i, p in enumerate(pieces)] + [(1, 0, "no key")], "span int, pos int, piece string")
    got = sorted((r.span, r.pos, r.sub) for r in metrics.name_arguments_cut(t).collect())
    assert got == [(0, 0, 10), (0, 1, 11), (0, 2, 11), (0, 3, 11), (1, 0, 10)]


def test_bootstrap_numpy(spark):
    p = metrics.per_prompt(stats(spark, EVENTS + MORE))
    ci = metrics.bootstrap_ci_numpy(p, "alpha", 50)
    assert ci["n_prompts"] == 2 and ci["ci95"][0] <= ci["mean"] <= ci["ci95"][1]


def test_sequences(spark):
    assert one(spark, seq.turn_starts(ints(-100, -100, 1, 2, -100, 3))) == [2, 5]
    assert one(spark, seq.turn_starts(ints(1, 2))) == [0] and one(spark, seq.turn_starts(ints(-100))) == [] and one(spark, seq.turn_starts(ints())) == []
    runs = one(spark, seq.rle(ints(0, 0, 1, 3, 3, 0)))
    assert [(r.code, r.len) for r in runs] == [(0, 2), (1, 1), (3, 2), (0, 1)]
    assert one(spark, seq.unrle(seq.rle(ints(0, 0, 1, 3, 3, 0)))) == [0, 0, 1, 3, 3, 0] and one(spark, seq.rle(ints())) == []
    assert one(spark, seq.first_divergence(ints(1, 2, 3), ints(1, 5, 3))) == 1
    assert one(spark, seq.first_divergence(ints(1, 2), ints(1, 2, 3))) == 2 and one(spark, seq.first_divergence(ints(1), ints(1))) is None
    assert one(spark, seq.ngram_propose(ints(5, 6, 7, 5, 6), F.lit(3))) == [7, 5, 6]
    assert one(spark, seq.ngram_propose(ints(1, 2, 3, 1, 2, 3), F.lit(2))) == [1, 2] and one(spark, seq.ngram_propose(ints(1, 2, 3, 4, 5), F.lit(2), pad=9)) == [9]
    assert one(spark, seq.clip_left(ints(*range(20)), 10, 99)) == list(range(10, 20))
    assert one(spark, seq.clip_left(ints(*range(20)), 10, 12)) == list(range(12, 20))
    assert one(spark, seq.prefixes(ints(7, 8, 9), ints(-100, 8, -100))) == [[7]]
    assert one(spark, seq.synced(ints(1, 2, 3, 4), F.lit(2), ints(9))) == [1, 2, 9]


EOS = 1


@pytest.mark.parametrize(
    "proposal, preds, budget, want",
    [
        ([10, 11], [99, 99, 99], 5, ([False], 99, "reject", False)), ([10, 11, 12], [10, 11, 55, 99], 5, ([True, True, False], 55, "reject", False)), ([10], [EOS, 99], 5, ([False], EOS, "reject", True)),
        ([10, EOS], [10, EOS, 99], 5, ([True, True], None, "full_eos", True)), ([10, 11], [10, 11, 20], 5, ([True, True], 20, "full_bonus", False)), ([10, 11], [10, 11, EOS], 5, ([True, True], EOS, "full_eos", True)),
        ([10, 11], [10, 11, 20], 2, ([True, True], None, "budget", True)), ([10, 11], [10, 11, 20], 3, ([True, True], 20, "full_bonus", False)),
    ],
)
def test_verify_round(spark, proposal, preds, budget, want):
    r = one(spark, seq.verify_round(ints(*proposal), ints(*preds), F.lit(budget), EOS))
    assert (r.mask, r.correction, r.step_type, r.eos) == want


def test_round_loop(spark):
    rows = spark.createDataFrame([("a", [5, 6, 7, 5], [6, 7, 9, 4]), ("b", [1], [5] * 20), ("c", [], []), ("d", None, [3])], "query_id string, prompt_ids array<int>, target_ids array<int>")
    out = {}
    for e in sorted(training.simulate(rows, 3, 7, EOS).collect(), key=lambda e: (e.query_id, e.step)):
        assert e.accept_mask == sorted(e.accept_mask, reverse=True) and len(e.draft_tokens) == len(e.accept_mask)
        out.setdefault(e.query_id, []).extend(e.draft_tokens[: sum(e.accept_mask)] + ([] if e.correction_token is None else [e.correction_token]))
    assert out["a"] == [6, 7, 9, 4, EOS] and out["b"] == [5] * 7 and out["c"] == [EOS]


def test_text(spark):
    assert one(spark, T.norm_query(F.lit("Step 12:  What's\n the weather? "))) == "What's the weather?" and one(spark, T.norm_query(F.lit(None).cast("string"))) == ""
    for a, (t, d) in {"str": ("string", None), "int, default=100": ("integer", "100"), "List[float]": ("array", None), "Tuple[int]": ("array", None), "dict": ("object", None), "Union[int, str]": ("string", None), "str, optional, default 'x y'": ("string", "x y"), "float, default=20": ("number", "20.0"), "int, default=z": ("integer", "z")}.items():
        assert (one(spark, T.json_type(F.lit(a))), one(spark, T.default_of(F.lit(a)))) == (t, d), a
    turn = "Thought: a\nAction: f\nAction Input: {bad\nAction: g\nAction Input: {'x': 1} \nAction: h\nArguments: {\"y\": true} tail"
    read = clean.read_turns(spark.range(1).select(F.lit(turn).alias("x")), "x").first()
    assert [g.name for g in read.calls] == ["g", "h"] and json.loads(read.calls[-1].arguments) == {"y": True}
    assert read.thought == "a"
    spans = one(spark, T.payload_spans(F.lit("a<c>xx</c><c></c><c>y"), "<c>", "</c>"))
    assert [(s.s, s.e) for s in spans] == [(4, 6)]
    nested = F.array(*(F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in [(5, 9), (0, 10), (8, 14)]))
    assert [(s.s, s.e) for s in one(spark, T.outermost(nested))] == [(0, 10), (8, 14)]
    assert one(spark, T.last_span(F.lit("abcabc"), F.lit("bc"))) == 4 and one(spark, T.last_span(F.lit("x"), F.lit("y"))) is None
    assert one(spark, T.repair_json_line(F.lit('xx {"a": 1}'))) == '{"a": 1}' and one(spark, T.basename(F.lit("a/b/c"))) == "c"


def tool_schemas():
    return F.create_map(F.lit("get_weather"), F.struct(F.array(F.lit("city"), F.lit("unit")).alias("allowed"), F.array(F.lit("city")).alias("required")))
CALL = '{"name": "get_weather", "arguments": {"city": "P"}}'


@pytest.mark.parametrize(
    "payloads, want",
    [
        ([CALL], []), ([f"{CALL},\n{CALL}"], []), ([f"{CALL} {CALL} ,,"], []), ([], ["no tool call in generation"]), (['{"name": "get_weather", "arguments": {"unit": "c"}}'], ["missing required keys for"]),
        (['{"name": "zz", "arguments": {}}'], ["unknown function name"]), (['{"name": "get_weather", "arguments": {"city": 1, "k": 2}}'], ["keys outside schema for"]), (["{broken"], ["payload not JSON"]), ([" "], ["payload not JSON"]),
        ([f", {CALL}"], ["payload not JSON"]), ([f"{CALL} garbage"], ["payload not JSON"]), (["5"], ["payload not an object"]), (['{"name": "get_weather", "arguments": 3}'], ["arguments not an object for"]),
    ],
)
def test_validate(spark, payloads, want):
    p = F.array(*map(F.lit, payloads)) if payloads else F.expr("cast(array() as array<string>)")
    assert one(spark, F.transform(T.validate(p, tool_schemas()), T.reason_key)) == want


def raw(convs, system='APIs: [{"name": "f", "description": "d"}, {"name": "Finish", "description": "e"}]'):
    convs = [("system", system), *convs]
    return ("Step 3: do it", ([c[0] for c in convs], [c[1] for c in convs]))


FIN = 'Thought: done\nAction: Finish\nAction Input: {"return_type": "give_answer", "final_answer": " 42 "}'
ACT = 'Thought: go\nAction: f\nAction Input: {"a": 1}'


@pytest.mark.parametrize(
    "convs, want",
    [
        ([("user", "hi\nBegin!\n"), ("assistant", ACT), ("function", "r"), ("assistant", FIN)], "kept"), ([("user", "hi"), ("assistant", FIN), ("function", "r"), ("assistant", FIN)], "early_finish"),
        ([("user", "hi"), ("assistant", ACT)], "no_finish"), ([("user", "hi"), ("assistant", ACT.replace("f\n", "nope\n")), ("assistant", FIN)], "unknown_action"), ([("user", "hi"), ("assistant", FIN.replace("give_answer", "give_up"))], "gave_up"),
        ([("user", "hi"), ("assistant", FIN), ("user", "x")], "last_not_assistant"), ([("user", "hi"), ("function", "r"), ("assistant", FIN)], "function_without_call"), ([("user", "hi"), ("assistant", "words"), ("assistant", FIN)], "unparseable_turn"),
        ([("user", "hi"), ("robot", "words"), ("assistant", FIN)], "unknown_role"), ([("assistant", FIN), ("assistant", FIN)], "bad_start"), ([("user", "hi"), ("assistant", FIN.replace(" 42 ", " "))], "blank_answer"),
    ],
)
def test_converted(spark, convs, want):
    r = clean.converted(spark.createDataFrame([raw(convs)], schemas.RAW_MULTI)).first()
    assert r.reason == want
    if want == "kept":
        assert [m.role for m in r.messages] == ["user", "assistant", "tool", "assistant"] and r.messages[0].content == "hi" and r.messages[2].name == "f"
        assert r.messages[3].content == "done\n\n 42" and r.meta.final_answer == "42" and r.meta.query == "do it" and r.meta.tool_names == ["f"]


def test_packs(spark):
    df = spark.createDataFrame([(0, 5), (1, 4), (2, 10)], "ord int, n int")
    at = lambda cap: [(r.ord, r.pack, r.offset) for r in training.greedy_packs(df, cap).orderBy("ord").collect()]
    assert at(16) == [(0, 0, 0), (1, 0, 5), (2, 1, 0)] and at(8) == [(0, 0, 0), (1, 1, 0)]
    rec = spark.createDataFrame([(0, "a", [1, 2, 3, 4, 5], [-100, -100, -100, 4, 5]), (1, "b", [6, 7, 8, 9], [-100, -100, -100, 9])], "ord int, query_id string, input_ids array<int>, labels array<int>")
    p = training.pack_arrays(training.greedy_packs(rec.withColumn("n", F.size("input_ids")), 16)).first()
    assert (p.position_ids, p.loss_positions, p.record_ids) == ([0, 1, 2, 3, 4, 0, 1, 2, 3], [3, 4, 8], ["a", "b"])
    assert [r.minor for r in training.mix_plan(spark, 8, 0.25).orderBy("slot").collect()] == [False, False, False, True] * 2
    assert not any(r.minor for r in training.mix_plan(spark, 4, 0).collect())
    with pytest.raises(ValueError):
        training.mix_plan(spark, 4, 0.5)


def test_packs_in_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 3, 9, 40, 99, 100])) for i in range(400)]
    pack, used, want = 0, 0, {}
    for i, n in rows:
        if used and used + n > 100:
            pack, used = pack + 1, 0
        want[i] = (pack, used)
        used += n
    df = spark.createDataFrame(rows, "ord long, n int").repartition(3)
    for size in (1000, 37, 5):
        assert {r.ord: (r.pack, r.offset) for r in training.greedy_packs(df, 100, rows_per_part=size).collect()} == want


def test_losses(spark):
    import math

    s, t = [0.1, 0.7, -0.3, 9.0], [1.0, 0.2, 0.4, -5.0]
    lp = lambda x: [v - math.log(sum(math.exp(y) for y in x[:3])) for v in x[:3]]
    a, b = lp(s), lp(t)
    arr = lambda x: F.array(*map(F.lit, x))
    rk = sum(math.exp(x) * (x - y) for x, y in zip(a, b))
    assert one(spark, losses.divergence_row(arr(s), arr(t), 3, "reverse_kl", 0.1)) == pytest.approx(0.9 * rk - 0.1 * a[0])
    assert one(spark, losses.divergence_row(arr(s), arr(s), 3, "jsd", 0.0)) == pytest.approx(0)
    top = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(b[i]).alias("lp")) for i in (0, 2)))
    z = math.log(math.exp(b[0]) + math.exp(b[2]))
    kl = sum(math.exp(b[i] - z) * (b[i] - z - a[i]) for i in (0, 2))
    assert one(spark, losses.topk_kl_row(arr(s), top, F.lit(1), 3, 0.2)) == pytest.approx(0.8 * kl - 0.2 * a[1])
    assert one(spark, losses.topk_kl_row(arr(s), F.lit(None).cast("array<struct<id: int, lp: double>>"), F.lit(1), 3, 0.2)) == pytest.approx(-a[1])
    with pytest.raises(PySparkException):
        one(spark, losses.topk_kl_row(arr(s), top, F.lit(3), 3, 0.2))
    with pytest.raises(ValueError):
        losses.divergence_row(arr(s), arr(t), 3, "other")


def test_joins_and_bench(spark):
    a, b = spark.createDataFrame([("x", [1, 2]), ("y", [3])], "query_id string, output_ids array<int>"), spark.createDataFrame([("x", [1, 5]), ("y", [3])], "query_id string, output_ids array<int>")
    s = bench.exactness_summary(bench.exactness(a, b)).first()
    assert (s.n_prompts, s.n_exact, s.n_mismatch, s.all_exact) == (2, 1, 1, False)
    with pytest.raises(PySparkException):
        bench.exactness(a, b.limit(1)).collect()
    with pytest.raises(PySparkException):
        assemble.join_one_to_one(a, b.limit(1), "query_id").collect()
    with pytest.raises(PySparkException):
        clean.pool_minus(a, spark.createDataFrame([("z",)], "query_id string"), "query_id").collect()
    assert bench.newest_checkpoint(spark.createDataFrame([("step-9",), ("step-100",), ("x",)], "name string")).first().name == "step-100"
    with pytest.raises(PySparkException):
        one(spark, bench.spec_config(F.lit("ngram"), F.lit(3), F.lit(""), F.lit(3), F.lit(2)))
    runs = spark.createDataFrame([("a", 1.0, 16, 12), ("a", 1.0, 16, 12), ("a", 10.0, 16, 12)], "tag string, wall_s double, gen_tokens int, prompt_tokens int")
    r = bench.run_medians(runs, "tag").first()
    assert (r.median_wall_s, r.median_gen_tok_s, r.median_total_tok_s) == (1.0, 16.0, 28.0)


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "ord int, v string")
    writers.single_parquet(d, str(tmp_path / "p"))
    frozen = integrity.manifest(spark, str(tmp_path / "p")).cache()
    assert frozen.count() >= 1 and integrity.verify_manifest(integrity.manifest(spark, str(tmp_path / "p")), frozen).count() == 0
    other = frozen.withColumn("sha256", F.lit("0"))
    assert {r.check for r in integrity.verify_manifest(frozen, other).collect()} == {"checksum"}
    assert {r.check for r in integrity.verify_manifest(frozen.limit(0), frozen).collect()} == {"missing"}
    assert readers.records(spark, str(tmp_path / "p"), 1).first().v == "a"
    (tmp_path / "log.jsonl").write_text('junk{"kind": "bench", "tag": "t", "spec_config": {"num_speculative_tokens": 5}}\nnone\n')
    assert readers.bench_log(spark, str(tmp_path / "log.jsonl"), strict=False).first().k == 5
    (tmp_path / "i.json").write_text("[5, 3]")
    assert [(r.idx, r.ord) for r in readers.index(spark, str(tmp_path / "i.json")).collect()] == [(5, 0), (3, 1)]
    assert writers.markdown_table(d.orderBy("ord")).endswith("| 2 | b |")


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame(EVENTS + MORE, schemas.EVENT).repartition(2).write.json(str(src))
    metrics_stream.start(metrics_stream.running_totals(metrics_stream.read_events(spark, str(src))), "totals", str(tmp_path / "cp")).awaitTermination(60)
    got = {r.query_id: (r.n_scored, r.n_accepted) for r in spark.table("totals").collect()}
    assert got == {"q0": (8, 6), "q1": (3, 2)}
