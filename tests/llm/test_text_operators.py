"""op1, op5, op6, op9 against brute force on a whole small table and on edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from turnlake.llm import mixing, minhash, pii, quality_rules

SF = "/root/testdata/sf0.001"
EDGES = [
    None, "", " \n\t ", "word", "a b c d", "A B C D", "one\ntwo\none\n \n\ntwo", "x y z x y z", "a a a a a a", "   é́ \x1c\x1d",
    "a@b.c a@b@c.de x@y.zz@w.vv .@-.-  @ a@b", "1.2.3.4.5.6.7.8.9 256.1.1.1 1.2.3.04 1..2.3.4 0000255.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111", "+1 (314) 555-6532 4663622617512349 +1 234 +49 170 1234567. +1..2",
    "IBAN: GB82 WEST 1234 5698 7654 32 account no. 12345678 https://me:pw@host.example/x", "9" * 5000, "1.1.1." * 2000, "ab " * 40000, "a@" * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(100_000 + i, t, None if i % 2 else "en", None if i % 3 else "s", None, 7) for i, t in enumerate(EDGES)]
    rows += [(200_000 + i, " ".join(f"w{(i * 7 + k) % 90 if k % 11 else i}" for k in range(80)), "en", "s", 1, 7) for i in range(30)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    return real.unionByName(more, allowMissingColumns=True).repartition(5).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_quality_rules(spark, docs, texts):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.apply_rules(docs, labels).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(texts[r.doc_id]), r
        assert not (r.kept and r.base_failed) and r.kept == (not r.base_failed and r.rule == 0)


def test_rules_separate_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.apply_rules(docs, labels).join(labels, "doc_id").where("not base_failed")
    got = {(r.quality, r.kept): r.n for r in out.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert got.get((1, False), 0) <= 0.01 * got[1, True]
    assert got.get((0, False), 0) >= 0.6 * sum(v for (q, _), v in got.items() if q == 0)


def test_rules_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.apply_rules(docs, none).where("kept = base_failed").count() == 0
    assert quality_rules.apply_rules(docs.limit(0), none).count() == 0


def test_no_python_in_rules(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plan = quality_rules.apply_rules(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_personal_data(docs, texts):
    for r in pii.personal_data(docs).collect():
        *counts, digest, base = brute.pii(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == [*counts, digest], texts[r.doc_id][:200]
        assert base <= set(r.spans.split(",")) | {""}


def test_personal_data_random():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789+@.- ()aZ%\n") for _ in range(rng.randint(0, 60)))
        base, _every = pii.find(t)
        assert [len(base[k]) for k in pii.BASE_KINDS] == list(brute.pii(t)[:4]), t


def test_run_together_numbers():
    t = "Elle +1 (569) 555-6633 4795326016703902 chtion a.b@c.de"
    assert pii.redact(t, pii.find(t)[1]) == "Elle [PHONE] [CARD] chtion [EMAIL]"


def test_near_duplicates(docs, texts):
    want = brute.near(texts.items())
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_chain_and_group(spark):
    base = [f"v{k}" for k in range(60)]
    rows = [(i, " ".join(base[: 40 + i])) for i in range(20)]  # neighbours are near, ends are not
    rows += [(100 + i, " ".join([*(f"g{k}" for k in range(100)), f"own{i}"])) for i in range(700)]
    rows += [(2000 + i, "same text in all of these rows here") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert out == {i: c for i, (_, c) in brute.near(rows).items()}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] += r.taken
    for (size, target), taken in by.items():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-6
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-3
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    words = mixing.repeat(docs).select(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("n")).first().n
    assert words == sum(r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_water_fill_stops(spark):
    s = spark.createDataFrame([("a", 10, 5), ("b", 1000, 2), (None, 0, 1)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.water_fill(s).collect()}
    assert got == {"a": 30.0, "b": 980.0, None: 0.0}
