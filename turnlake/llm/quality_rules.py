"""Quality rules as a learned decision list, in DataFrame and SQL functions alone.

Statistics of each text are Spark expressions. Sequential covering (grow and prune, as in
IREP) learns ordered rules for the low-quality class from labelled statistics: a rule is
a conjunction of thresholds grown on one fold by FOIL's gain until it covers no good text,
cut back to its best prefix on the other, and taken only while it is precise there; what it
covers is then set aside. The list is emitted as one ordered CASE WHEN expression.

Rules are fitted on at most SAMPLE labelled texts, those with the lowest hash of doc_id, in
one collect of a few numbers each; statistics and verdicts cover all texts.

Edge cases: a null text counts as no words and fails the base rule; without labels of
both classes the list is empty and only the base rule decides; null labels are ignored; of
several labels of a document the lowest counts; a repeated document repeats, and counts as
often as a labelled text; other columns (such as toxic) are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import WORD, materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RULES = 8
MAX_CONDITIONS = 4
#: Labelled texts that the rules are fitted on.
SAMPLE = 20_000
#: Of a rule on the pruning fold.
MIN_PRECISION = 0.95
MIN_COVERED = 3
#: With fewer bad texts in the pruning fold, all texts are in both folds.
MIN_FOLD = 15

#: name -> SQL over the statistics' columns.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_text_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "stops_per_word": "n_stops / greatest(n_words, 1)",
}

#: Words in 3-word windows that occur twice or more. Only texts with such a window sort
#: (hash, place) pairs; the union of windows at sorted places is summed by its gaps.
_REPEATED = """
CASE WHEN size(tri) = size(array_distinct(tri)) THEN 0L ELSE
  transform(array(array_sort(transform(tri, (h, i) -> struct(h AS h, i AS i)))), s ->
    aggregate(
      array_sort(transform(filter(s, (x, k) -> get(s, k - 1).h <=> x.h OR get(s, k + 1).h <=> x.h), x -> x.i)),
      struct(0L AS n, -3 AS last),
      (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last),
      a -> a.n))[0]
END"""


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id and the counts that base rule and features use."""
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    words = text.select("doc_id", "text", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"), lines.alias("lines"))
    tri = "transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))"
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    counted = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[.!?]").alias("n_stops"),
        F.expr(tri).alias("tri"),
    )
    return counted.select("*", F.expr(_REPEATED).cast("long").alias("n_repeat_words")).drop("tri")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(conditions: Rule) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def decision_list(rules: list[Rule]) -> Column:
    """The ordered rules as one conditional expression: false where one fires."""
    if not rules:
        return F.lit(True)
    out = F.when(_all(rules[0]), F.lit(False))
    for r in rules[1:]:
        out = out.when(_all(r), F.lit(False))
    return out.otherwise(F.lit(True))


Example = tuple[bool, bool, tuple[float, ...]]  # bad, in the pruning fold, a value per feature


def _gain(p: int, n: int, before_p: int, before_n: int) -> float:
    """FOIL's gain of a condition that leaves p and n of before_p bad and before_n good examples."""
    return p * (math.log2(p / (p + n)) - math.log2(before_p / (before_p + before_n))) if p else -math.inf


def _best_condition(rows: list[Example], orders: list[list[int]], alive: list[bool]) -> tuple[int, bool, float] | None:
    """The (feature, above, threshold) of the highest gain; thresholds lie midway between
    neighbouring values. Of equal gains the first feature, threshold and "above" wins."""
    all_p = sum(rows[i][0] for i, a in enumerate(alive) if a)
    all_n = sum(alive) - all_p
    if not all_p or not all_n:
        return None
    best, found = 1e-9, None
    for f, order in enumerate(orders):
        p = n = 0  # at or under the threshold
        last = None
        for i in order:
            if not alive[i]:
                continue
            bad, _, values = rows[i]
            v = values[f]
            if last is not None and v != last:
                for above, hit_p, hit_n in ((True, all_p - p, all_n - n), (False, p, n)):
                    if hit_p >= MIN_COVERED and (g := _gain(hit_p, hit_n, all_p, all_n)) > best + 1e-9:
                        best, found = g, (f, above, (last + v) / 2)
            last = v
            p, n = p + bad, n + (not bad)
    return found


def _holds(values: tuple[float, ...], conditions: list[tuple[int, bool, float]]) -> bool:
    return all((values[f] > t) == above for f, above, t in conditions)


def cover(rows: list[Example], max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Sequential covering of the bad examples."""
    if sum(bad and prune for bad, prune, _ in rows) < MIN_FOLD:  # too few to set any aside: both folds are all rows
        grow, prune = list(range(len(rows))), list(range(len(rows)))
    else:
        grow, prune = [i for i, r in enumerate(rows) if not r[1]], [i for i, r in enumerate(rows) if r[1]]
    orders = [sorted(grow, key=lambda i: rows[i][2][f]) for f in range(len(FEATURES))]
    names, left, out = list(FEATURES), [True] * len(rows), []
    growing = set(grow)
    while len(out) < max_rules:
        alive = [left[i] and i in growing for i in range(len(rows))]
        grown: list[tuple[int, bool, float]] = []
        while len(grown) < max_conditions and (c := _best_condition(rows, orders, alive)):
            grown.append(c)
            alive = [a and _holds(rows[i][2], [c]) for i, a in enumerate(alive)]
        if not grown:
            break
        scores = []
        for k in range(1, len(grown) + 1):
            hit = [rows[i][0] for i in prune if left[i] and _holds(rows[i][2], grown[:k])]
            p, n = sum(hit), len(hit) - sum(hit)
            scores.append(((p - n) / max(1, p + n), -k, p, n))
        _, k, p, n = max(scores)
        if p < MIN_COVERED or p < min_precision * (p + n):
            break
        rule = grown[:-k]
        out.append(tuple(Condition(names[f], above, t) for f, above, t in rule))
        left = [x and not _holds(rows[i][2], rule) for i, x in enumerate(left)]
    return out


def learn(labelled: DataFrame, sample: int = SAMPLE, **parameters) -> list[Rule]:
    """Rules for rows with bad = true. labelled: doc_id, the statistics and bad boolean."""
    h = F.xxhash64("doc_id", F.lit("rules"))
    values = F.array(*(F.expr(f).cast("double") for f in FEATURES.values()))
    some = labelled.select(h.alias("h"), "doc_id", "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), values.alias("values"))
    rows = [(r.bad, r.prune, tuple(r["values"])) for r in some.orderBy("h", "doc_id").limit(sample).collect()]  # the bound: sample rows of a few numbers
    return cover(rows, **parameters)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels (doc_id, quality: 0 is low) and judge all docs (doc_id, text): doc_id,
    the base counts, base_failed, kept, and rule: the number of the rule that fired, or 0."""
    stats = materialize(statistics(docs))
    bad = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") == 0).alias("bad"))
    labelled = stats.where(~base_failed()).join(bad, F.col("doc_id") == F.col("id")).drop("id")
    rules = learn(labelled)
    verdict = decision_list(rules)
    fired = F.coalesce(*(F.when(_all(r), F.lit(k + 1)) for k, r in enumerate(rules)), F.lit(0))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict).alias("kept"), F.when(~base_failed(), fired).otherwise(0).alias("rule"),
    )
