"""Collocations, conversation repair and sharding against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnlake.llm import collocations as C
from turnlake.llm import conversation_repair as R
from turnlake.llm import sharding as S

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# collocations


def plain_collocations(docs, top=2000, least=10, longest=3):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        rows = []
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            if any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def some_docs(seed, n=60):
    rng = random.Random(seed)
    words = ["New", "york", "the", "CITY", "é", "Ä", "of", "a b", "x\x00y"] + [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        t = []
        for _ in range(rng.randrange(120)):
            t.append(rng.choice(["New York CITY", "of the", "the"]) if rng.random() < 0.4 else rng.choice(words))
            t.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]))
        out.append((i, "".join(t), rng.choice(["en", "en", "de", None, "und"]), "s", 0))
    return out + [(100, None, "en", "s", 0), (101, "", "fr", None, 0), (102, " .\n", "fr", None, 0)] + out[:7]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_collocations_equal_plain(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "MAX_BITS", bits)  # a full bitmap lets all phrases through
    docs = some_docs(1)
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOCS + ", phrase string")
    got = C.collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(docs)
    assert want and any(len(r[2].split(" ")) == 3 for r in want)
    assert sorted(map(tuple, got.collect())) == want


def test_collocations_longer_phrases_and_top(spark):
    docs = some_docs(2)
    got = C.collocations(spark.createDataFrame(docs, DOCS), top=5, min_count=4, longest=4)
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, 5, 4, 4)


def test_collocations_edges(spark):
    assert C.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, None, None), (2, "a b", "en", "", 1)], DOCS)).count() == 0


def test_collocations_of_a_very_long_text(spark):
    text = "red Fox runs " * 600_000  # about two slices without a break
    got = {r["phrase"]: r for r in C.collocations(spark.createDataFrame([(1, text, "en", "s", 1)], DOCS)).collect()}
    assert got["red fox runs"]["a"] == 600_000 and got["fox runs red"]["a"] == 599_999 and got["red fox runs"]["n"] == 1_800_000


def test_slices_overlap_counts_nothing_twice():
    rng = random.Random(4)
    text = b"".join(rng.choice([b"a", b"bb", b"ccc"]) + rng.choice([b" ", b". ", b"\t"]) for _ in range(500))
    assert b"".join(C.slices(text, 16)) == text
    for limit in (3, 16, 50):
        parts = list(C.slices(text, limit))
        assert [w for p in parts for w in p.replace(b".", b" . ").split()] == text.replace(b".", b" . ").split()


def test_scores_are_exact(spark):
    a, l, r = 3_037_000_501, 3_037_000_507, 9_007_199_254_740_993
    t = lambda *rows: spark.createDataFrame(rows, "lang string, phrase string, n bigint")
    got = C.scored([t(("en", "x", l), ("en", "y", r)), t(("en", "x y", a))]).collect()
    assert [tuple(g) for g in got] == [("en", "x y", a, l, r, 1000000 * a * a // (l * r))]


def test_apriori_emits_only_phrases_of_frequent_parts(spark):
    docs = spark.createDataFrame([(i, "a b rare%d a b" % i, "en", "s", 0) for i in range(20)], DOCS)
    _, tables = C.levels(docs)
    pairs = {r["phrase"] for r in C.counted(docs, 2, C.bitmap_of(tables[0])).collect()}
    assert pairs == {"a b"}


def test_first_of_each_takes_ties_in_order(spark):
    rows = spark.range(9000).select(F.lit("en").alias("lang"), F.format_string("p%05d", "id").alias("phrase"), F.lit(1).alias("score"))
    got = C.first_of_each(rows, 30, [F.col("score").desc(), F.col("phrase")]).collect()
    assert sorted((r["rank"], r["phrase"]) for r in got) == [(i + 1, f"p{i:05d}") for i in range(30)]


# conversations


def plain_plan(rows):
    """Cheapest edits by a uniform-cost search over (cost, edits): rows are (initial, must go, truncated)."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, edits, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits
        if len(roles) > len(rows) + 3 or not any(re.fullmatch("(s?(ua)+)?", roles + t) for t in ("", "a", "ua")):
            continue
        key = (i, roles[:1] == "s", roles[-1:])
        if (key, cost, edits) in seen:
            continue
        seen.add((key, cost, edits))
        for r in "ua":
            heapq.heappush(heap, (cost + 2, edits + "I", i, roles + r))
        if i < len(rows):
            initial, go, cut = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, roles))
            if not go:
                heapq.heappush(heap, (cost + cut, edits + "K", i + 1, roles + initial if initial in "sua" and initial else roles + "x"))
                for r in "ua":
                    heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, roles + r))
    return None


def plain_audit(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        out = convs[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            out += [(turn, role, text)] * (2 if kind == 3 else 1)
    res = []
    for conv, rs in convs.items():
        md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r)))
        seen, sig, faults, illegal = set(), [], Counter(), 0
        for i, (_, role, text) in enumerate(rs):
            shown = re.sub("[\x20\x09-\x0d]", "", text)
            fault = "blank" if not shown else "dup" if (role, text) in seen else "cut" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            sig.append((role[:1], fault in ("blank", "dup"), int(fault == "cut")))
            illegal += i > 0 and sig[i - 1][0] + sig[i][0] not in ("su", "ua", "au")
        turns = [t for t, _, _ in rs if t is not None]
        cost, audit = plain_plan(sig)
        new, i = [], 0
        for e in audit:
            last = new[-1][0][:1] if new else ""
            want = "assistant" if last == "u" else "user"
            if e == "I":
                new.append((want, ""))
                continue
            if e != "D":
                new.append((rs[i][1] if e == "K" else want, rs[i][2]))
            i += 1
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in new).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        res.append((conv, gaps, faults["blank"], faults["dup"], faults["cut"], illegal, cost, audit, sha))
    return sorted(res, key=str)


CONV = "conv_id bigint, turn bigint, role string, text string"


def test_shared_plans_equal_search():
    rng = random.Random(7)
    letters = {c: ("x" if c == "x" else c.lower() if c != "-" else "u", c == "-", int(c.isupper())) for c in "suaxSUAX-"}
    sigs = {"".join(rng.choice("suaxUA-") for _ in range(rng.randrange(7))) for _ in range(300)} | {"SUAX-"[:i] for i in range(6)}
    got = R.solve(sigs)
    assert got.keys() == sigs
    for s in sigs:
        assert got[s] == plain_plan([letters[c] for c in s]), s


def test_layers_are_computed_once_per_prefix(monkeypatch):
    calls = []
    real = R.layer
    monkeypatch.setattr(R, "layer", lambda *a: calls.append(1) or real(*a))
    sigs = {"".join(p) for k in range(6) for p in itertools.product("ua", repeat=k)}
    R.solve(sigs)
    assert len(calls) == len(sigs) - 1  # one per node of the trie but the root


def test_repair_equals_plain(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(250), None]:
        for t in range(rng.randrange(1, 8)):
            text = rng.choice(["Hi.", "Hi.", "Was?", "no end", " \t", "", None, "zwei\nZeilen!", "é ..  ", f"text {rng.random()}."])
            role = ["user", "assistant"][t % 2] if rng.random() < 0.7 else rng.choice(["system", "tool", "", None, "User", "agent"])
            rows.append((c, rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.2 else t, role, text))
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], CONV + ", audit string, stats int")
    got = R.audit(R.damaged(df))
    assert [x for x, _ in got.dtypes] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert all(k == "bigint" for _, k in got.dtypes[:7])
    assert sorted(map(tuple, got.collect()), key=str) == plain_audit(rows)


def test_repair_edges(spark):
    assert R.audit(R.damaged(spark.createDataFrame([], CONV))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in R.audit(R.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV))).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    far = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    assert R.audit(spark.createDataFrame(far, CONV)).first()["gaps"] == (1 << 63) - 1


def test_one_very_long_conversation(spark):
    rows = spark.range(60_000).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.format_string("t %d.", "id").alias("text"))
    got = R.audit(rows).first()
    want = hashlib.sha256("\n".join(f"{'assistant' if i % 2 else 'user'}:t {i}." for i in range(60_000)).encode()).hexdigest()
    assert got["audit"] == "K" * 60_000 and got["cost"] == 0 and got["repaired_sha256"] == want


def test_repaired_rows_alternate(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "assistant", "b."), (2, 0, "tool", "c."), (2, 1, "user", "d"), (3, None, "user", "")]
    got = defaultdict(list)
    for r in R.repaired(spark.createDataFrame(rows, CONV)).orderBy("conv_id", "place").collect():
        got[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert got[1] == [("R", "user", "a."), ("K", "assistant", "b.")]
    assert got[2] and [x[1][0] for x in got[2]] == ["u", "a"] and 3 not in got


# shards


def test_shards_equal_plain(spark):
    rows = [(i, f"text {i} é", "en", "s", 0) for i in range(700)] + [(None, None, None, None, None), (3, "text 3 é", "en", "s", 0), (3, "other", "en", "s", 0), (1 << 62, "", "en", "s", 0)]
    got = S.shard_documents(spark.createDataFrame([(*r, 9) for r in rows], DOCS + ", shard int")).collect()
    places = defaultdict(list)
    for r in got:
        draws = [hashlib.md5(f"shard-1:{'null' if r['doc_id'] is None else r['doc_id']}:{s}".encode()).hexdigest() for s in range(17)]
        assert r["shard"] == draws.index(max(draws[:16])) and r["grown_shard"] == draws.index(max(draws)) and r["law"] == "key"
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_a_hot_key_is_written_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1000)
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    got = S.shard_documents(rows)
    n = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert sum(r["n"] for r in n) == 20_000 and all(r["n"] == r["d"] == r["b"] + 1 and r["a"] == 0 for r in n)
    assert S.shard_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_weights_share_and_few_rows_move(spark):
    rows = spark.range(40_000).withColumnRenamed("id", "k")
    n = {r["shard"]: r["count"] for r in S.assign(rows, "k", [4.0, 2.0, 1.0, 0.0, 1.0]).groupBy("shard").count().collect()}
    assert 3 not in n and all(abs(n[s] / 40_000 - w / 8) < 0.01 for s, w in ((0, 4), (1, 2), (2, 1), (4, 1)))
    for old, new, takers in (([1.0] * 9, [1.0] * 10, {9}), ([1.0, 1.0, 1.0], [1.0, 2.0, 1.0], {1})):
        moved = S.moves(rows, "k", old, new).where("old_shard <> new_shard").collect()
        assert moved and {r["new_shard"] for r in moved} == takers
    lost = S.moves(rows, "k", [1.0] * 4, [1.0, 1.0, 0.0, 1.0]).where("old_shard <> new_shard").collect()
    assert {r["old_shard"] for r in lost} == {2} and {r["new_shard"] for r in lost} == {0, 1, 3}
    with pytest.raises(ValueError):
        S.assign(rows, "k", [0.0])


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"), "id")
    S.write_shards(rows, str(tmp_path / "out"), "k", 5, files=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("id").distinct().count() == back.count() == 3000
    assert back.join(S.assign(rows, "k", 5, name="want"), "id").where("shard <> want").count() == 0
