"""Distillation losses on logit arrays, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions.seq import let


def log_sum_exp(a: Column) -> Column:
    return let(a, lambda v: let(F.array_max(v), lambda top: top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))))


def log_softmax(logits: Column, real_vocab: int) -> Column:
    """Over the real vocabulary: padding columns are cut first."""
    a = F.transform(F.slice(logits, 1, real_vocab), lambda x: x.cast("double"))
    return let(a, lambda v: let(log_sum_exp(v), lambda z: F.transform(v, lambda x: x - z)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


NO_TEACHER = "cast(array() as array<struct<id: int, lp: double>>)"


def topk_kl_row(logits: Column, teacher: Column, label: Column, real_vocab: int, sft_weight: float) -> Column:
    """(1 - w) KL over the teacher's renormalised top-k plus w cross entropy; cross entropy
    alone without a teacher. teacher: array<struct<id, lp>>, lp of -inf on padding.
    Ids outside the real vocabulary are an error."""
    finite = F.filter(F.coalesce(teacher, F.expr(NO_TEACHER)), lambda t: t["lp"] > F.lit(float("-inf")))

    def row(logp: Column, t: Column) -> Column:
        kl = let(log_sum_exp(F.transform(t, lambda x: x["lp"])), lambda z: _sum(F.transform(t, lambda x: F.exp(x["lp"] - z) * (x["lp"] - z - F.get(logp, x["id"])))))
        ce = -F.get(logp, label)
        bad = (label < 0) | (label >= real_vocab) | F.exists(t, lambda x: x["id"] >= real_vocab)
        return F.when(bad, F.raise_error(F.lit("id outside the real vocabulary")).cast("double")).when(F.size(t) > 0, (1 - sft_weight) * kl + sft_weight * ce).otherwise(ce)

    return let(log_softmax(logits, real_vocab), lambda logp: let(finite, lambda t: row(logp, t)))


def divergence_row(student: Column, teacher: Column, real_vocab: int, div: str = "reverse_kl", sft_weight: float = 0.1) -> Column:
    """(1 - w) divergence + w cross entropy to the teacher's argmax (first of ties)."""
    if div not in ("reverse_kl", "forward_kl", "jsd"):
        raise ValueError(f"unknown divergence {div!r}")
    mid = lambda a, b: F.log(0.5 * (F.exp(a) + F.exp(b)))
    term = {
        "reverse_kl": lambda a, b: F.exp(a) * (a - b),
        "forward_kl": lambda a, b: F.exp(b) * (b - a),
        "jsd": lambda a, b: 0.5 * (F.exp(a) * (a - mid(a, b)) + F.exp(b) * (b - mid(a, b))),
    }[div]

    def row(s: Column, t: Column) -> Column:
        target = (F.array_position(t, F.array_max(t)) - 1).cast("int")
        return (1 - sft_weight) * _sum(F.zip_with(s, t, term)) - sft_weight * F.get(s, target)

    return let(log_softmax(student, real_vocab), lambda s: let(log_softmax(teacher, real_vocab), lambda t: row(s, t)))


def pad_teacher(rows: Column, width: Column) -> Column:
    """Rows padded to a width: ids 0, log-probabilities -inf."""
    pad = F.struct(F.lit(0).alias("id"), F.lit(float("-inf")).alias("lp"))
    return F.transform(rows, lambda r: F.concat(F.slice(F.coalesce(r, F.expr("cast(array() as array<struct<id: int, lp: double>>)")), F.lit(1), width), F.array_repeat(pad, F.greatest(width - F.coalesce(F.size(r), F.lit(0)), F.lit(0)))))
