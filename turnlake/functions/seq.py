"""Token sequences as arrays: run lengths, turns, prefixes, proposals, rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.schemas import NO_LOSS, REGION_PROSE

NO_INTS = "cast(array() as array<int>)"
#: offsets sums this many tokens at a time.
RUN = 64


def let(value: Column, body) -> Column:
    """body(value) with value computed once: Spark would repeat an expression that a lambda captures."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(a: Column) -> Column:
    """0 to size - 1; empty for an empty array."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.expr(NO_INTS))


def rle(a: Column) -> Column:
    """array<struct<code, len>> of equal runs, linear in the array."""
    starts = lambda v: F.filter(indices(v), lambda i: (i == 0) | ~F.get(v, i).eqNullSafe(F.get(v, i - 1)))
    runs = lambda v, at: F.transform(at, lambda s, k: F.struct(F.get(v, s).alias("code"), (F.coalesce(F.get(at, k + 1), F.size(v)) - s).alias("len")))
    return let(a, lambda v: let(starts(v), lambda at: runs(v, at)))


def unrle(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["code"], r["len"].cast("int"))))


def run_ends(runs: Column) -> Column:
    """array<struct<code, e>> of runs (code, len): e is where a run ends."""
    return let(runs, lambda v: F.zip_with(v, offsets(F.transform(v, lambda r: r["len"].cast("int"))), lambda r, o: F.struct(r["code"].cast("int").alias("code"), o["e"].alias("e"))))


def touched(runs: Column, s: Column, e: Column) -> Column:
    """array<struct<code, s, e>> of the runs (code, e) that meet places s to e - 1; prose behind the
    last. The first is found by bisection among the ends."""

    def of(v: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(32))

        def first(at: Column) -> Column:  # the number of runs that end at or before a place
            def half(a: Column, _: Column) -> Column:
                mid = ((a["lo"] + a["hi"]) / 2).cast("int")
                right = (a["lo"] < a["hi"]) & F.coalesce(F.get(v, mid)["e"] <= at, F.lit(False))
                return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right, a["hi"]).otherwise(mid).alias("hi")))

            return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(v).alias("hi")), half, lambda a: a["lo"])

        def some(lo: Column) -> Column:
            hi = first(e - 1)  # the run of the last place
            inside = F.transform(F.slice(v, lo + 1, F.greatest(F.lit(0), F.least(hi + 1, F.size(v)) - lo)), lambda r, i: F.struct(r["code"].alias("code"), F.coalesce(F.get(v, lo + i - 1)["e"], F.lit(0)).alias("s"), r["e"].alias("e")))
            end = F.coalesce(F.try_element_at(v, F.lit(-1))["e"], F.lit(0))
            beyond = F.array(F.struct(F.lit(REGION_PROSE).alias("code"), end.alias("s"), F.greatest(e, end).alias("e")))
            none = F.expr("cast(array() as array<struct<code: int, s: int, e: int>>)")
            return F.concat(inside, F.when(e > end, beyond).otherwise(none))

        return let(first(s), some)

    return let(runs, of)


def turn_starts(labels: Column) -> Column:
    """Places where a label follows a place without loss, or the start."""
    return let(labels, lambda v: F.filter(indices(v), lambda i: (F.get(v, i) != NO_LOSS) & ((i == 0) | (F.get(v, i - 1) == NO_LOSS))))


def region_at(regions: Column, at: Column) -> Column:
    """The region at a place; prose past the end."""
    return F.coalesce(F.get(regions, at), F.lit(REGION_PROSE))


def first_divergence(a: Column, b: Column) -> Column:
    """The first place where two lists differ, or the shorter's length; null if equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(at > 0, at - 1)


def common_prefix(a: Column, b: Column) -> Column:
    return F.coalesce(first_divergence(a, b), F.size(a).cast("bigint"))


def synced(seq: Column, pre_len: Column, emitted: Column) -> Column:
    """A proposer's sequence after a round: it keeps what agrees with the emitted tokens."""
    return F.concat(F.slice(seq, F.lit(1), pre_len), emitted)


def prompt(ids: Column, n: Column) -> Column:
    """ids[:n]; a bound outside (0, size) is an error."""
    return F.when((n > 0) & (n < F.size(ids)), F.slice(ids, F.lit(1), n)).otherwise(F.raise_error(F.lit("prompt bound outside the record")).cast("array<int>"))


def prefixes(ids: Column, labels: Column) -> Column:
    """One prefix per turn start."""
    return let(ids, lambda v: F.transform(turn_starts(labels), lambda s: F.slice(v, F.lit(1), s)))


def clip_left(ids: Column, most: int, start_token: int) -> Column:
    """The last `most` ids; a cut inside a turn moves on to the next start token if there is one."""
    cut = F.slice(ids, F.greatest(F.size(ids) - most + 1, F.lit(1)), F.lit(most))
    at = F.array_position(cut, F.lit(start_token)).cast("int")
    moved = F.when(at > 1, F.slice(cut, at, F.size(cut))).otherwise(cut)
    return F.when(F.size(ids) <= most, ids).otherwise(moved)


def ngram_propose(seq: Column, k: Column, max_n: int = 3, min_n: int = 1, pad: int = 0) -> Column:
    """Followers of the earliest earlier occurrence of the longest suffix, at most k; else [pad].

    One pass finds where the last token occurs earlier; longer suffixes are sought among these places only."""

    def of(v: Column, ends: Column, n: int) -> Column:
        """ends: where the earlier occurrences of the last n tokens end."""
        here = F.when(F.size(ends) > 0, F.slice(v, F.get(ends, F.lit(0)) + 2, k)) if n >= min_n else F.lit(None)
        if n == max_n:
            return here
        longer = F.filter(ends, lambda e: (e >= n) & F.get(v, e - n).eqNullSafe(F.get(v, F.size(v) - 1 - n)))
        return F.coalesce(let(longer, lambda at: of(v, at, n + 1)), here)

    def ends(v: Column) -> Column:
        earlier = F.when(F.size(v) > 1, F.sequence(F.lit(0), F.size(v) - 2)).otherwise(F.expr(NO_INTS))
        return let(F.get(v, F.size(v) - 1), lambda last: F.filter(earlier, lambda e: F.get(v, e).eqNullSafe(last)))

    return let(seq, lambda v: F.coalesce(let(ends(v), lambda at: of(v, at, 1)), F.array(F.lit(pad))))


def verify_round(proposal: Column, preds: Column, budget: Column, eos: int) -> Column:
    """struct<mask, correction, step_type, eos> of one round; preds has one more token than the proposal."""
    kind = "struct<mask: array<boolean>, correction: int, step_type: string, eos: boolean>"
    row = lambda mask, correction, kind, end: F.struct(mask.alias("mask"), correction.cast("int").alias("correction"), F.lit(kind).alias("step_type"), end.alias("eos"))
    wrong = F.raise_error(F.lit("verifier predictions length is not proposal + 1")).cast(kind)

    def full(proposal: Column, preds: Column) -> Column:
        n = F.size(proposal)
        bonus, all_true = F.get(preds, n), F.array_repeat(F.lit(True), n)
        return (
            F.when(F.element_at(proposal, -1) == eos, row(all_true, F.lit(None), "full_eos", F.lit(True)))
            .when((budget > n) & (bonus == eos), row(all_true, bonus, "full_eos", F.lit(True)))
            .when(budget > n, row(all_true, bonus, "full_bonus", F.lit(False)))
            .otherwise(row(all_true, F.lit(None), "budget", F.lit(True)))
        )

    def of(proposal: Column, preds: Column) -> Column:
        at = F.array_position(F.zip_with(proposal, F.slice(preds, F.lit(1), F.size(proposal)), lambda x, y: x == y), F.lit(False)).cast("int")
        rejected = lambda at: let(F.get(preds, at - 1), lambda fix: row(F.concat(F.array_repeat(F.lit(True), at - 1), F.array(F.lit(False))), fix, "reject", fix == eos))
        return F.when(F.size(preds) != F.size(proposal) + 1, wrong).otherwise(let(at, lambda i: F.when(i > 0, rejected(i)).otherwise(full(proposal, preds))))

    return let(proposal, lambda p: let(preds, lambda q: of(p, q)))


def round_events(target: Column, found: Column, k: int, budget: int, eos: int) -> Column:
    """The rounds of one turn as array<struct<step, draft_tokens, accept_mask, correction_token, eos,
    step_type>>, folded over verify_round.

    Whatever is proposed, what is emitted are the target's next tokens, so the state is their number.
    The text so far is then always a start of prompt and target: what ngram_propose finds in it is
    known beforehand, as found, for each number (training.proposals, of k tokens at most)."""
    event = "struct<step: int, draft_tokens: array<int>, accept_mask: array<boolean>, correction_token: int, eos: boolean, step_type: string>"
    zero = F.struct(F.lit(0).alias("n"), F.lit(budget < 1).alias("end"), F.expr(f"cast(array() as array<{event}>)").alias("events"))

    def played(a: Column, p: Column, target: Column) -> Column:
        preds = F.slice(target, a["n"] + 1, F.size(p) + 1)

        def after(r: Column) -> Column:
            e = F.struct(F.size(a["events"]).alias("step"), F.slice(p, F.lit(1), F.size(r["mask"])).alias("draft_tokens"), r["mask"].alias("accept_mask"), r["correction"].alias("correction_token"), r["eos"].alias("eos"), r["step_type"].alias("step_type"))
            n = a["n"] + F.size(F.array_remove(r["mask"], False)) + r["correction"].isNotNull().cast("int")
            return let(n, lambda n: F.struct(n.alias("n"), (r["eos"] | (n >= budget)).alias("end"), F.concat(a["events"], F.array(e)).alias("events")))

        return let(verify_round(p, preds, F.lit(budget) - a["n"], eos), after)

    def step(a: Column, target: Column, found: Column) -> Column:
        proposal = F.slice(F.get(found, a["n"]), F.lit(1), F.lit(budget) - a["n"])
        return F.when(a["end"], a).otherwise(let(proposal, lambda p: played(a, p, target)))

    turns = F.sequence(F.lit(1), F.lit(max(budget, 1)))
    fold = lambda target, found: F.aggregate(turns, zero, lambda a, _: step(a, target, found), lambda a: a["events"])
    ended = F.concat(F.transform(target, lambda t: F.coalesce(t, F.lit(eos))), F.array_repeat(F.lit(eos), k + 1))  # nothing but ends behind the target
    return let(ended, lambda x: let(found, lambda y: fold(x, y)))


def sort_logprobs(entries: Column) -> Column:
    """array<struct<id, lp>> by lp down, then id up; null becomes empty."""
    order = F.array_sort(F.transform(entries, lambda x: F.struct((-x["lp"]).alias("key"), x["id"].alias("id"), x["lp"].alias("lp"))))
    return F.coalesce(F.transform(order, lambda x: F.struct(x["id"].alias("id"), x["lp"].alias("lp"))), F.expr("cast(array() as array<struct<id: int, lp: double>>)"))


def with_eos(ids: Column, finish: Column, eos: int) -> Column:
    """Append the end token if generation stopped and withheld it."""
    return F.when((finish == "stop") & ~F.element_at(ids, -1).eqNullSafe(F.lit(eos)), F.concat(ids, F.array(F.lit(eos)))).otherwise(ids)


def scan(values: Column, zero: Column, kind: str, step) -> Column:
    """The states after each value: step(state, value) from zero on. kind: the state's type.

    Appending copies what is there, so the states before runs of RUN values come first."""
    none = F.expr(f"cast(array() as array<{kind}>)")

    def after(run: Column, state: Column) -> Column:
        both = lambda acc, x: let(step(acc["state"], x), lambda n: F.struct(n.alias("state"), F.concat(acc["out"], F.array(n)).alias("out")))
        return F.aggregate(run, F.struct(state.alias("state"), none.alias("out")), both, lambda a: a["out"])

    def joined(runs: Column) -> Column:
        ahead = lambda acc, run: F.struct(F.aggregate(run, acc["state"], step).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))
        states = F.aggregate(runs, F.struct(zero.alias("state"), none.alias("out")), ahead, lambda a: a["out"])
        return F.flatten(F.zip_with(runs, states, after))

    return let(values, lambda v: let(_runs(v), joined))


def _runs(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(RUN)), lambda at: F.slice(v, at + 1, F.lit(RUN)))


def offsets(lengths: Column) -> Column:
    """array<struct<s, e>> of tokens from their lengths, by a running sum.

    Appending copies what is there, so runs of RUN tokens are summed apart, each from its own start."""
    empty, none = F.expr("cast(array() as array<struct<s: int, e: int>>)"), F.expr(NO_INTS)

    def of_run(run: Column, at: Column) -> Column:
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (acc["at"] + n).alias("e")))).alias("out"))
        return F.aggregate(run, F.struct(at.alias("at"), empty.alias("out")), step, lambda a: a["out"])

    def joined(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
        return F.flatten(F.zip_with(runs, starts, of_run))

    return let(lengths, lambda v: let(_runs(v), joined))


def regions_of(offs: Column, spans: list[tuple[Column, int]], default: int = REGION_PROSE) -> Column:
    """Per token the code of the first list of spans that holds its start."""

    def of(o: Column, held: list[Column]) -> Column:
        out = F.lit(default)
        for span, (_, code) in reversed(list(zip(held, spans, strict=True))):
            out = F.when(F.exists(span, lambda x: (x["s"] <= o["s"]) & (o["s"] < x["e"])), F.lit(code)).otherwise(out)
        return out

    def bind(left: list[Column], held: list[Column]) -> Column:
        return let(left[0], lambda v: bind(left[1:], [*held, v])) if left else F.transform(offs, lambda o: of(o, held))

    return bind([c for c, _ in spans], [])


def loss_labels(ids: Column, offs: Column, turns: Column) -> Column:
    """A token wholly inside a turn keeps its id, one outside has no loss, one across a border is an error."""
    both = F.arrays_zip(ids.alias("id"), offs.alias("o"))

    def of(x: Column, turns: Column) -> Column:
        o = x["o"]
        whole = F.exists(turns, lambda t: (t["s"] <= o["s"]) & (o["e"] <= t["e"]))
        touch = F.exists(turns, lambda t: (t["s"] < o["e"]) & (o["s"] < t["e"]))
        return F.when(whole, x["id"]).when(touch, F.raise_error(F.lit("token straddles a turn")).cast("int")).otherwise(F.lit(NO_LOSS))

    return let(turns, lambda t: F.transform(both, lambda x: of(x, t)))
