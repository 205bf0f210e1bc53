"""Packs with teacher rows, alignment, digests of large files, joined verification, resumed stages, printed reports."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_operators import EVENTS, MORE
from turnlake import cli, schemas
from turnlake.functions import render
from turnlake.operators import integrity, metrics, reporting, training

RECORD = "ord int, query_id string, input_ids array<int>, labels array<int>, gen_logprob_token_ids array<array<int>>, gen_logprob_values array<array<double>>"


def test_packs_carry_teacher_rows(spark):
    rows = [(0, "a", [1, 2, 3], [-100, 2, 3], [[2, 9], None], [[-0.1, -2.0], None]), (1, "b", [5, 6], [-100, 6], [[6]], [[-0.3]]), (2, None, [], [], [], [])]
    rec = reporting.teacher_rows(spark.createDataFrame(rows, RECORD)).withColumn("n", F.size("input_ids"))
    placed = training.greedy_packs(rec, 5)
    p = training.pack_arrays(placed)
    b = reporting.batch_arrays(p, 2, "record_ids").first()
    assert b.teacher_ids == [[2, 9], [0, 0], [6, 0]] and b.valid == [True, False, True] and b.labels == [2, 3, 6] and b.keep == [0, 1, 3] and b.record_ids == ["a", "b", None]
    share = training.label_share(placed).first()
    assert (share.n_label_tokens, share.label_share) == (3, 0.6)
    assert training.label_share(placed.limit(0)).first().label_share is None
    bad = spark.createDataFrame([(0, "x", [4], [4])], "ord int, query_id string, input_ids array<int>, labels array<int>").withColumn("n", F.lit(1))
    with pytest.raises(PySparkException, match="place 0 of x"):
        training.pack_arrays(training.greedy_packs(bad, 5)).collect()


def test_alignment_of_texts_and_bytes(spark):
    df = spark.createDataFrame([(0, ["ab", " ", "c"]), (1, ["a", "b c"]), (2, [])], "id int, pieces array<string>")
    got = {r.id: r for r in render.aligned(df).collect()}
    assert [got[i].roundtrip_exact for i in range(3)] == [True, False, True]
    assert [tuple(o) for o in got[1].offsets] == [(0, 1), (1, 4)] and got[1].text == "ab c"
    pieces = [bytearray(b"x\xc3"), bytearray(b"\xa9"), bytearray("é😀".encode()[:3]), bytearray("é😀".encode()[3:])]
    raw = spark.createDataFrame([(0, pieces), (1, [bytearray(b"\xff")]), (2, [bytearray("é".encode()), bytearray(b" ")])], "id int, pieces array<binary>")
    got = {r.id: r for r in render.aligned(raw).collect()}
    ends, so_far = [], b""
    for p in pieces:  # decoding ever longer prefixes
        so_far += bytes(p)
        ends.append(len(so_far.decode("utf-8", "replace")))
    assert got[0].text == "xéé😀" and [o.e for o in got[0].offsets] == ends
    assert [got[i].roundtrip_exact for i in range(3)] == [False, False, True] and got[1].text == "\ufffd"


def test_calls_are_cut_in_the_report(spark, tmp_path, capsys):
    pieces = ["p", '{"na', 'me": "f", ', '"argu', 'ments": ', "{}}", "q"]
    runs = [(0, 1), (2, 5), (1, 1)]
    df = spark.createDataFrame([(runs, pieces), ([(2, 2)], ["a", "b"]), ([], [])], "regions array<struct<code: int, len: int>>, pieces array<string>")
    got = [[tuple(x) for x in r.s] for r in df.select(metrics.sub_regions(F.col("regions"), F.col("pieces")).alias("s")).collect()]
    assert got == [[(0, 1), (10, 2), (11, 3), (1, 1)], [(10, 2)], []]
    ev = spark.createDataFrame(EVENTS + MORE, schemas.EVENT)
    texts = ["x", '{"name": 1, ', '"arguments": {', *["y"] * 37]
    rec = spark.createDataFrame([(q, [(0, 1), (2, 39)], [-100, 5], 1, texts) for q in ("q0", "q1")], "query_id string, regions array<struct<code: int, len: int>>, labels array<int>, n_prompt_tokens int, pieces array<string>")
    r = reporting.full_report(ev, rec, n_boot=20, pieces="pieces")
    assert r["region_n_verified"] == {"2": 11} and r["subcut_n_verified"] == {"10": 2, "11": 9}
    ev.coalesce(1).write.json(str(tmp_path / "events"))
    rec.write.parquet(str(tmp_path / "records"))
    assert cli.main(["report", str(tmp_path / "events"), "--records", str(tmp_path / "records"), "--subcut", "--out", str(tmp_path / "out")]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["flat"]["alpha"] == 8 / 11 and said["subcut_n_verified"] == {"10": 2, "11": 9} and spark.read.json(str(tmp_path / "out")).count() == 2


def test_large_files_in_chunks(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    with open(tmp_path / "d" / "large file.bin", "wb") as f:
        f.truncate(3 << 30)  # sparse, above what a value can hold
    (tmp_path / "d" / "small.txt").write_text("x")
    got = {r.file: (r.sha256, r.bytes) for r in integrity.manifest(spark, str(tmp_path / "d")).collect()}
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(3 << 6):
        want.update(zeros)
    assert got == {"large file.bin": (want.hexdigest(), 3 << 30), "small.txt": (hashlib.sha256(b"x").hexdigest(), 1)}


def test_joined_verification(spark, tmp_path):
    idx = lambda *xs: spark.createDataFrame([(x,) for x in xs], "idx long")
    path, raw = str(tmp_path / "f"), tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_text("a")
    was = spark.createDataFrame(integrity.manifest(spark, str(raw)).collect(), "file string, sha256 string, bytes long")
    frozen = integrity.freeze(spark, path, {"eval": spark.range(5)}, {"pool": idx(1, 2, 3), "stage": idx(1, 2), "held": idx(9)})
    rules = dict(disjoint=[("held", "pool", "idx")], subset=[("stage", "pool", "idx")], size={"eval": 5, "stage": 2}, non_empty=["held"], raw={str(raw): was})
    assert integrity.verify(spark, path, frozen, **rules).collect() == []
    rules |= dict(disjoint=[("stage", "pool", "idx")], size={"eval": 4}, subset=[("held", "pool", "idx"), ("gone", "pool", "idx")])
    (raw / "a.txt").write_text("b")
    got = {(r.check, r.item) for r in integrity.verify(spark, path, frozen, **rules).collect()}
    assert got == {("stage overlaps pool", "2"), ("held not in pool", "1"), ("rows of eval", "5"), ("raw checksum", "a.txt")}
    for f in (tmp_path / "f" / "pool").glob("*.json"):
        f.unlink()
    got = {r.check for r in integrity.verify(spark, path, frozen, **(rules | {"raw": {str(tmp_path / "none"): was}})).collect()}
    assert got == {"missing", "rows of eval", "raw folder missing"}


def test_stages_resume(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "stage"), []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(integrity, "_mark", killed)
        with pytest.raises(KeyboardInterrupt):
            integrity.resumed(spark, path, "one", make)
    assert integrity.resumed(spark, path, "one", make).count() == 2  # written but unmarked: redone
    assert integrity.resumed(spark, path, "one", make).count() == 2 and len(calls) == 2
    assert integrity.resumed(spark, path, "two", make).count() == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1")
    first = integrity.fingerprint(integrity.manifest(spark, str(tmp_path / "in")), "k", 3)
    assert first == integrity.fingerprint(integrity.manifest(spark, str(tmp_path / "in")), "k", 3)
    (tmp_path / "in" / "a").write_text("2")
    assert first != integrity.fingerprint(integrity.manifest(spark, str(tmp_path / "in")), "k", 3)
