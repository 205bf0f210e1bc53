"""Python literals, tails, string answers and real resampling."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnlake import schemas
from turnlake.functions import literals
from turnlake.operators import clean, integrity, metrics


@pytest.mark.parametrize(
    "text, want",
    [
        ("{'a': 'None of True'}", {"a": "None of True"}), ("{'n': 1, 'f': True}", {"n": 1, "f": True}), ("{'a': \"it's\", 'b': {'c': None}, 'd': (1, 2)}", {"a": "it's", "b": {"c": None}, "d": [1, 2]}),
        ("{'a': 'it\\'s', 'b': 'say \"x\"', 'c': [1.5, -2,],}", {"a": "it's", "b": 'say "x"', "c": [1.5, -2]}), ('{"y": true} tail', {"y": True}), ("5 tail", 5), ("{bad", None), ("['a']", None), ("{'a': f(1)}", None), ("", None),
    ],
)
def test_payload(spark, text, want):
    got = spark.range(1).select(literals.payload(F.lit(text)).alias("x")).first().x
    assert (None if got is None else json.loads(got)) == want


def test_thought_keeps_the_tail(spark):
    turn = "Thought: a\nThought:\nb\nAction: f\nAction Input: {'x': 1}\nAction: g\nArguments: {broken\nmore"
    r = clean.read_turns(spark.range(1).select(F.lit(turn).alias("x")), "x").first()
    assert r.thought == "a\nb\nAction: g\nArguments: {broken\nmore" and [x.name for x in r.calls] == ["f"]


def finish(answer):
    return f'Thought: done\nAction: Finish\nAction Input: {{"return_type": "give_answer", "final_answer": {answer}}}'


@pytest.mark.parametrize("apis, answer, want", [("[{'name': 'f', 'description': None, 'strict': True}]", '"x"', "kept"), ('[{"name": "f"}]', "42", "blank_answer"), ("[{'name': 'f'}", '"x"', "no_api_list"), ("[]", '"x"', "no_api_list")])
def test_lists_and_answers(spark, apis, answer, want):
    rows = [("Step 1: q", (["system", "user", "assistant"], [f"APIs: {apis}", "hi", finish(answer)]))]
    assert clean.converted(spark.createDataFrame(rows, schemas.RAW_MULTI)).first().reason == want


def test_bootstrap_resamples(spark):
    for r in entry.queries()["q26_bootstrap_ci"](spark, "/root/testdata/sf0.001").collect():
        assert r.lo < r.mean < r.hi


@pytest.mark.parametrize("n", [1, 128, 129, 700])
def test_draws_by_counts(spark, n):
    """Totals are exactly n, counts spread as binomial ones, and intervals are numpy's but for chance."""
    import numpy as np

    depth = (-(-n // metrics.LEAF) - 1).bit_length()
    rows = spark.range(1 << depth).withColumnRenamed("id", "leaf").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(1999))))
    got = rows.withColumn("m", metrics._share(n, depth, 42)).toPandas()
    assert (got.groupby("b")["m"].sum() == n).all()
    if depth:
        share = 1 / (1 << depth)
        assert 0.88 < got["m"].var() / (n * share * (1 - share)) < 1.12
    values = np.random.default_rng(n).random(n)
    p = spark.createDataFrame([(f"q{i:04}", float(v), None) for i, v in enumerate(values)], "query_id string, alpha double, tau double")
    alpha, tau = metrics.bootstrap_cis(p, ["alpha", "tau"], 400).collect()
    exact = metrics.bootstrap_ci_numpy(p, "alpha", 400)
    assert alpha.n_prompts == n and abs(alpha.mean - values.mean()) < 1e-6 and (tau.mean, tau.lo, tau.hi) == (0, 0, 0)
    width = exact["ci95"][1] - exact["ci95"][0]
    assert abs(alpha.hi - alpha.lo - width) <= 0.25 * width + 1e-6 and abs(alpha.lo - exact["ci95"][0]) <= 0.25 * width + 1e-6


def test_draws_of_no_prompts(spark):
    r = metrics.bootstrap_ci(spark.createDataFrame([], "query_id string, alpha double"), "alpha").first()
    assert (r.mean, r.lo, r.hi, r.n_prompts) == (None, None, None, 0)


def test_draws_are_never_rows(spark):
    """The plan has no cross join with the prompts and shuffles sums only."""
    p = spark.range(1000).select(F.col("id").cast("string").alias("query_id"), F.rand(1).alias("alpha"))
    plan = metrics.bootstrap_ci(p, "alpha", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Join Inner" not in plan


def test_numpy_sample():
    got = clean.numpy_sample(100, 10)
    assert got == sorted(set(got)) and len(got) == 10 and max(got) < 100 and got == clean.numpy_sample(100, 10)


def test_manifest_tells_folders_apart(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "x" / d).mkdir(parents=True)
        (tmp_path / "x" / d / "same.txt").write_text(d)
    assert {r.file for r in integrity.manifest(spark, str(tmp_path / "x")).collect()} == {"a/same.txt", "b/same.txt"}


def some_literal(rng, depth=0):
    """A random JSON or Python literal as text, with odd spacing, repeated keys and odd numbers."""
    kinds = ["num", "str", "word", "list", "dict", "dict"] if depth < 3 else ["num", "str", "word"]
    kind = rng.choice(kinds) if depth else "dict"
    sub = lambda: some_literal(rng, depth + 1)
    if kind == "num":
        return rng.choice(["1", "1.0", "-0.50", "1e3", "12345678901234567890123456789012345678901", "NaN", "0x1f", "1_000", "-Infinity"])
    if kind == "str":
        return rng.choice(['"a\\n"', "'it\\'s'", '"q\\"x"', "'\\x41'", '"\\u00e9"', "'é' 'b'", '"\\ud800"', "b'x'"])
    if kind == "word":
        return rng.choice(["true", "false", "null", "True", "None", "f(1)"])
    if kind == "list":
        o, c = rng.choice(["[]", "()", "[]"])
        return o + ", ".join(sub() for _ in range(rng.randrange(3))) + rng.choice(["", ",", " "]) + c
    return "{" + rng.choice([", ", ","]).join(f"{rng.choice(chr(34) + chr(39))}{rng.choice('zab')}{rng.choice(chr(34) + chr(39))}: {sub()}" for _ in range(rng.randrange(4))) + "}" + ("" if depth else rng.choice(["", "", " tail", "}"]))


def test_payload_equals_pythons_readers(spark):
    import ast
    import random

    rng = random.Random(11)
    texts = [some_literal(rng) for _ in range(10_000)]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4).select("i", literals.payload(F.col("t")).alias("x")).orderBy("i").collect()]
    parsed = 0
    for t, g in zip(texts, got, strict=True):
        try:
            want = json.JSONDecoder().raw_decode(t.strip())[0]
        except ValueError:
            try:
                want = ast.literal_eval(t.strip())
                want = json.dumps(want) and want if isinstance(want, dict) else None
            except (ValueError, SyntaxError, TypeError):
                want = None
        assert (g is None) == (want is None), t
        if want is not None:
            parsed += 1
            assert json.dumps(json.loads(g)) == json.dumps(want), t
    assert parsed > 2000


def test_payload_keeps_what_variants_lose(spark):
    texts = ['{"b": 1, "a": 2}', '{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1.0}', "{'a': (1)}", "{'a': (1,)}", "null", "[" * 100_000, None]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", literals.payload(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ['{"b":1,"a":2}', '{"a":2}', '{"a":NaN}', '{"a":1.0}', '{"a":1}', '{"a":[1]}', None, None, None]


def test_tool_schemas_keep_all_properties(spark):
    tool = {"name": "f", "parameters": {"properties": {"b": {"type": "string", "enum": ["x", 1.0], "example_value": 3, "description": ""}, "a": "str"}, "required": ["b", "gone"], "optional": ["a"]}}
    got = spark.range(1).select(literals.tool_schemas(F.lit(json.dumps([tool]))).alias("x")).first().x
    want = {"type": "function", "function": {"name": "f", "description": "", "parameters": {"type": "object", "properties": {"b": {"type": "string", "enum": ["x", 1.0]}, "a": {"type": "string"}}, "required": ["b"]}}}
    assert [json.loads(x) for x in got] == [want]


def test_single_turn_keeps_arguments_and_defaults(spark):
    from turnlake.operators import assemble

    tools = json.dumps([{"name": "f", "parameters": {"p": {"type": "int", "default": 3}, "q": {"type": "str", "default": "3"}, "r": {"type": "float, default=2.5"}, "s": {"type": "str, optional"}, "t": {"type": "List[int]", "default": [1.5]}}}])
    answers = '[{"name": "f", "arguments": {"z": 1, "a": 2.0, "z": 3}}, {"name": "g", "arguments": {}}]'
    r = assemble.single_turn_messages(spark.createDataFrame([(1, "q", tools, answers)], schemas.RAW_SINGLE)).first()
    assert [c.arguments for c in r.messages[1].tool_calls] == ['{"z":3,"a":2.0}', "{}"] and r.n_answers == 2
    p = r.tools[0].parameters
    assert [p[k].default_json for k in "pqrst"] == ["3", '"3"', "2.5", None, "[1.5]"] and [p[k].required for k in "pqrst"] == [False] * 5
    with pytest.raises(Exception, match="broken JSON in row 7"):
        assemble.single_turn_messages(spark.createDataFrame([(7, "q", tools, "[{")], schemas.RAW_SINGLE)).collect()
