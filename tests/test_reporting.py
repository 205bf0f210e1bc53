"""Reports, teacher rows, gathers, turns and freezes."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_operators import EVENTS, MORE
from turnlake import schemas
from turnlake.operators import integrity, reporting, training
from turnlake.sources import writers


def test_full_report_and_its_files(spark, tmp_path):
    ev = spark.createDataFrame(EVENTS + MORE, schemas.EVENT)
    rec = spark.createDataFrame([(q, [(1, 40)], [-100, 5], 1) for q in ("q0", "q1")], "query_id string, regions array<struct<code: int, len: int>>, labels array<int>, n_prompt_tokens int")
    r = reporting.full_report(ev, rec, n_boot=50)
    assert r["flat"]["alpha"] == 8 / 11 and r["flat"]["alpha_n"][0] == 4 / 5 and r["region_n_verified"] == {"1": 11} and r["region_alpha"] == {"1": 8 / 11}
    assert r["ci"]["tau"]["ci95"][0] <= r["ci"]["tau"]["mean"] <= r["ci"]["tau"]["ci95"][1]
    writers.report_json(r, str(tmp_path / "per"))
    assert [x.query_id for x in spark.read.json(str(tmp_path / "per")).orderBy("query_id").collect()] == ["q0", "q1"]
    rest = json.loads(spark.read.text(str(tmp_path / "per.json")).first().value)
    assert rest["flat"]["tau"] == 8 / 5 and reporting.tau_pair(rest, rest)[0] == 8 / 5


def test_teacher_rows_and_batches(spark):
    ddl = "labels array<int>, gen_logprob_token_ids array<array<int>>, gen_logprob_values array<array<double>>"
    ok = spark.createDataFrame([([-100, 7, 8], [[7, 9], None], [[-0.1, -2.0], None])], ddl)
    t = reporting.teacher_rows(ok).first().teacher
    assert [(x.id, x.lp) for x in t[0]] == [(7, -0.1), (9, -2.0)] and t[1] is None
    for bad in ([-100, 7], [[7], [8]], [[-0.1], [-0.2]]), ([7], [[7]], [[-0.1]]):
        with pytest.raises(PySparkException):
            reporting.teacher_rows(spark.createDataFrame([bad], ddl)).collect()
    packs = reporting.teacher_rows(ok).select(F.lit(0).alias("pack"), F.array(*map(F.lit, (5, 7, 8))).alias("input_ids"), F.array(F.lit(1), F.lit(2)).alias("loss_positions"), "teacher")
    b = reporting.batch_arrays(packs, 3).first()
    assert b.teacher_ids == [[7, 9, 0], [0, 0, 0]] and b.valid == [True, False] and b.labels == [7, 8] and b.keep == [0, 1] and b.teacher_lps[0][2] == float("-inf")


def test_gathers(spark):
    index = spark.createDataFrame([(0, 40), (1, 41), (2, 42)], "ord long, raw_idx long")
    got = reporting.dereference(spark.createDataFrame([(0, 2), (1, 0)], "ord long, idx long"), index)
    assert sorted(map(tuple, got.collect())) == [(0, 42), (1, 40)]
    raw = spark.createDataFrame([(40, "a"), (42, "b")], "raw_idx long, v string")
    assert {r.ord: r.v for r in reporting.gather(raw, got).collect()} == {0: "b", 1: "a"}
    with pytest.raises(PySparkException):
        reporting.dereference(spark.createDataFrame([(0, 9)], "ord long, idx long"), index).collect()
    with pytest.raises(PySparkException):
        reporting.gather(raw.limit(1), got).collect()
    c, g = spark.createDataFrame([("x",), ("y",)], "query_id string"), spark.createDataFrame([("x", [1]), ("y", [2])], "query_id string, output_ids array<int>")
    assert reporting.with_generations(c, g).count() == 2
    with pytest.raises(PySparkException):
        reporting.with_generations(c, g.limit(1)).collect()
    v = spark.createDataFrame([(True, True), (True, False), (False, True)], "valid boolean, roundtrip_exact boolean")
    assert reporting.keep_exact(v).count() == 1


def test_turns_restart_from_the_truth(spark):
    ids = [9, 9, 5, 6, 7, 9, 8, 4]
    labels = [-100, -100, 5, 6, 7, -100, 8, 4]
    rec = spark.createDataFrame([("a", ids, labels), ("b", ids[:5], labels[:5])], "query_id string, input_ids array<int>, labels array<int>")
    out = training.simulate_turns(rec, 2, 4, 1)
    said = {}
    for e in sorted(out.collect(), key=lambda e: (e.query_id, e.turn or 0, e.step)):
        n = sum(e.accept_mask)
        said.setdefault((e.query_id, e.turn), []).extend([*e.draft_tokens[:n], *([] if e.correction_token is None else [e.correction_token])])
    assert said == {("a", 0): [5, 6, 7, 1], ("a", 1): [8, 4, 1], ("b", None): [5, 6, 7, 1]}


def test_freeze_verifies(spark, tmp_path):
    frozen = integrity.freeze(spark, str(tmp_path / "f"), {"eval": spark.range(5)}, {"pool": spark.createDataFrame([(3,), (1,)], "idx long")})
    assert {r.file.split("/")[0] for r in frozen.collect()} == {"eval", "pool"}
    (tmp_path / "f" / "pool" / "more.json").write_text("x")
    assert [r.check for r in integrity.verify_manifest(integrity.manifest(spark, str(tmp_path / "f")), frozen).collect()] == ["extra"]


def test_small_parts(spark, tmp_path):
    assert reporting.temperature("greedy") == 0 and reporting.temperature("0.7") == 0.7
    for bad in ("-1", "nan"):
        with pytest.raises(ValueError):
            reporting.temperature(bad)
    assert reporting.call_tags("x<a>\n<t>\n{}\n</t>\n<e>", "<a>", "<e>") == ("<t>", "</t>")
    with pytest.raises(ValueError):
        reporting.call_tags("<a>\n<t>\n{}\n<t>\n<e>", "<a>", "<e>")
    assert set(reporting.provenance()) == {"ts", "commit"}
    r = spark.range(1).select(reporting.finish_reason(F.lit("length")).alias("a"), reporting.finish_reason(F.lit("eos")).alias("b")).first()
    assert tuple(r) == ("length", "stop")
    writers.append_samples(spark.createDataFrame([(0, "single", [1, 2], 5)], "micro int, source string, input_ids array<int>, n_sampled int"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().n_ctx_tokens == 2
