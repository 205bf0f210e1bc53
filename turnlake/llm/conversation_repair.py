"""Repair of conversation structure by edits of least cost, with a DP shared in a trie.

A conversation is a signature: one letter per row for its role's initial and its fault.
Its cheapest edits (Keep, Rerole, Delete, Insert) give role initials `(s?(ua)+)?`. The DP
keeps, per prefix of a signature, the least cost of each of four states (nothing yet,
after s, after u, after a). Signatures are sorted, so that the trie of their prefixes is
walked depth first: a layer is computed once per shared prefix and kept for the path to
the current node alone. A terminal node marks the states that lie on a cheapest path and
follows the ASCII-least edits through them.

Two passes. Faults, digests of texts and initials are Spark expressions; the first pass
deals these narrow rows by conversation and plans edits. The second deals the texts once,
each conversation's plan in front of its rows, and applies the edits row by row. Neither
holds a conversation's texts; per row of the conversation at hand, the first keeps its
letter and its layer. (A conversation's audit is one value, so it has to fit into one.)

Edge cases: a null id is a conversation of its own; null role or text counts as one space;
rows of equal turn go by role, then by the MD5 of role and text; an empty role has no
initial and can't be kept; extra columns are ignored; an empty table gives an empty
result; conversations of which damage left no row have zeros and an empty audit; gaps
above the largest long are that long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_batches, materialize

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Signatures planned together, and their letters.
CONVERSATIONS, LETTERS = 20_000, 4_000_000
SPACE, SHOWN = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The only role that a rerole or an insertion can give in a state, and the state behind it.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ENDS = (START, AFTER_A)
NEVER = 1 << 60


def edits(state: int, letter: str) -> list[tuple[str, int, int]]:
    """(edit, cost, state behind) for a row, in ASCII order. Letters: s, u, a, x (other) for
    whole rows, in capitals for truncated ones, - for rows that must go."""
    out = [("D", DELETE, state)]
    if letter != "-":
        add = TRUNCATED if letter.isupper() else 0
        if (to := KEEP.get((state, letter.lower()))) is not None:
            out.append(("K", add, to))
        out.append(("R", REROLE + add, NEXT[state]))
    return out


EDITS = {c: [edits(s, c) for s in range(4)] for c in "suaxSUAX-"}


def inserted(cost: list[int]) -> list[int]:
    """Least costs after any insertions: no cheapest path passes a state twice."""
    for _ in range(3):
        for s in range(4):
            cost[NEXT[s]] = min(cost[NEXT[s]], cost[s] + INSERT)
    return cost


def layer(before: list[int], letter: str) -> list[int]:
    out = [NEVER] * 4
    for s, moves in enumerate(EDITS[letter]):
        for _, c, to in moves:
            out[to] = min(out[to], before[s] + c)
    return inserted(out)


def traced(signature: str, layers: list[list[int]]) -> tuple[int, str]:
    """Cost and ASCII-least cheapest edits, from the layers of a signature's prefixes."""
    n = len(signature)
    best = min(layers[n][s] for s in ENDS)
    good = [[False] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, mark = layers[i], good[i]
        if i == n:
            for s in ENDS:
                mark[s] = here[s] == best
        else:
            after, ahead = layers[i + 1], good[i + 1]
            for s in range(4):
                mark[s] = any(ahead[to] and here[s] + c == after[to] for _, c, to in EDITS[signature[i]][s])
        for _ in range(3):
            for s in range(4):
                mark[s] |= mark[NEXT[s]] and here[s] + INSERT == here[NEXT[s]]
    out, i, s = [], 0, START
    while True:
        if i < n:
            options = [(e, i + 1, to) for e, c, to in EDITS[signature[i]][s] if good[i + 1][to] and layers[i][s] + c == layers[i + 1][to]]
        elif s in ENDS and layers[n][s] == best:
            return best, "".join(out)
        else:
            options = []
        if good[i][NEXT[s]] and layers[i][s] + INSERT == layers[i][NEXT[s]]:
            options.append(("I", i, NEXT[s]))
        e, i, s = min(options)
        out.append(e)


def solve(signatures: set[str]) -> dict[str, tuple[int, str]]:
    """(cost, audit) of each signature; layers are computed once per shared prefix."""
    path, layers, out = "", [inserted([0, NEVER, NEVER, NEVER])], {}
    for signature in sorted(signatures):
        shared = 0
        for a, b in zip(path, signature):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for letter in signature[shared:]:
            layers.append(layer(layers[-1], letter))
        out[signature] = traced(signature, layers)
        path = signature
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage: by crc32('conv_id:turn') % 20, rows are dropped (0), emptied (1), lose their
    ends (2), are repeated (3) or become the user's (4). Returns conv_id, turn, role, text and gone:
    dropped rows stay as marks of their conversation."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    kind = F.crc32(F.concat(blank(F.col("conv_id").cast("string")), F.lit(":"), blank(F.col("turn").cast("string"))).cast("binary")) % 20
    text = blank(F.col("text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(blank(F.col("role")))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return out.withColumn("_n", F.explode(F.expr("sequence(1, _n)"))).drop("_n")


def _keyed(rows: DataFrame) -> DataFrame:
    """conv (text, '' for a null id), turn, role, text, gone and the digest of role and text."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    out = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"), gone.alias("gone"))
    return out.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _first(rows: Column) -> Column:
    return F.left(rows, F.lit(1))


PLAN = "conv string, stats array<bigint>, audit string"


def plans(rows: DataFrame) -> DataFrame:
    """conv, stats (gaps, blank, duplicate, truncated, illegal, cost) and audit per conversation."""
    bounded_batches(rows.sparkSession)
    last = F.right(F.regexp_replace("text", f"{SPACE}+$", ""), F.lit(1))
    fault = F.when(~F.regexp_like("text", F.lit(SHOWN)), "b").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    narrow = _keyed(rows).select("conv", "turn", "role", "digest", _first(F.col("role")).alias("initial"), fault.alias("fault"), "gone")
    again = F.row_number().over(Window.partitionBy("conv", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())) > 1
    narrow = narrow.withColumn("again", again).withColumn("turn", F.col("turn"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "again"]
    dealt = narrow.repartition("conv").sortWithinPartitions(*order).select("conv", F.col("turn").cast("string").alias("turn"), "initial", "fault", "again", "gone")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for f in frames:
                yield from zip(*(f[c].tolist() for c in ("conv", "turn", "initial", "fault", "again", "gone")))

        def flush(found: list) -> pd.DataFrame:
            answers = solve({s for _, _, s in found})
            return pd.DataFrame({"conv": [c for c, _, _ in found], "stats": [[*st, answers[s][0]] for _, st, s in found], "audit": [answers[s][1] for _, _, s in found]})

        found, letters = [], 0
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            signature, blank, again_n, cut, illegal, turns, low, high, seen, before = [], 0, 0, 0, 0, 0, None, None, None, None
            for _, turn, initial, fault, again, gone in group:
                if gone:
                    continue
                if turn is not None and turn != seen:
                    turns, seen, high = turns + 1, turn, int(turn)
                    low = high if low is None else low
                letter = initial if initial in ("s", "u", "a") else "x"
                if before is not None and before + letter not in ("su", "ua", "au"):
                    illegal += 1
                before = letter
                if fault == "b":
                    blank, letter = blank + 1, "-"
                elif again:
                    again_n, letter = again_n + 1, "-"
                elif fault == "t":
                    cut, letter = cut + 1, letter.upper()
                signature.append(letter)
            gaps = 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)
            found.append((conv, [gaps, blank, again_n, cut, illegal], "".join(signature)))
            letters += len(signature)
            if len(found) >= CONVERSATIONS or letters >= LETTERS:
                yield flush(found)
                found, letters = [], 0
        if found:
            yield flush(found)

    return dealt.mapInPandas(run, PLAN)


def _applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows."""
    state, at = START, 0

    def give() -> str:
        nonlocal state
        state = NEXT[state]
        return "user" if state == AFTER_U else "assistant"

    for role, text in rows:
        while audit[at] == "I":
            at += 1
            yield "I", give(), ""
        edit, at = audit[at], at + 1
        if edit == "K":
            state = KEEP[state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield edit, give(), text
    for _ in audit[at:]:
        yield "I", give(), ""


def _apply(rows: DataFrame, planned: DataFrame, emit, schema: str) -> DataFrame:
    """emit(conv, stats, audit, repaired rows) -> result rows, for every conversation; texts pass by
    in order, each conversation's plan in front."""
    bounded_batches(rows.sparkSession)
    heads = planned.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit("").alias("digest"), "stats", "audit", F.lit(0).alias("kind"))
    body = _keyed(rows).where("not gone").select("conv", "turn", "role", "text", "digest", F.lit(None).cast("array<bigint>").alias("stats"), F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = heads.unionByName(body).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "stats", "audit")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each() -> Iterator[tuple]:
            for f in frames:
                yield from zip(*(f[c].tolist() for c in ("conv", "kind", "role", "text", "stats", "audit")))

        out, size = [], 0
        for conv, group in groupby(each(), key=lambda r: r[0]):
            head = next(group)
            for row in emit(conv, head[4], head[5], _applied(head[5], ((r[2], r[3]) for r in group))):
                out.append(row)
                size += 100 + sum(len(x) for x in row if isinstance(x, str))
                if size > 8_000_000:
                    yield pd.DataFrame(dict(zip(names, map(list, zip(*out)))))
                    out, size = [], 0
        if out:
            yield pd.DataFrame(dict(zip(names, map(list, zip(*out)))))

    return dealt.mapInPandas(run, schema)


def _conv_id(rows: DataFrame) -> Column:
    kind = rows.schema["conv_id"].dataType
    return F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K, R or I), role, text."""
    planned = materialize(plans(rows))

    def emit(conv, stats, audit, new):
        for i, (edit, role, text) in enumerate(new):
            yield conv, i, edit, role, text

    out = _apply(rows, planned, emit, "conv string, place bigint, edit string, role string, text string")
    return out.select(_conv_id(rows), "place", "edit", "role", "text")


def audit(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of
    its repaired `role:text` lines."""
    planned = materialize(plans(rows))

    def emit(conv, stats, audit, new):
        digest = hashlib.sha256()
        for i, (_, role, text) in enumerate(new):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode("utf-8", "replace"))
        yield conv, stats, audit, digest.hexdigest()

    out = _apply(rows, planned, emit, "conv string, stats array<bigint>, audit string, repaired_sha256 string")
    stats = [F.get("stats", F.lit(i)).alias(n) for i, n in enumerate(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))]
    return out.select(_conv_id(rows), *stats, "audit", "repaired_sha256")
