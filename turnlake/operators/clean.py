"""Cleaning, deduplication, rarity carve and splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from turnlake.functions import literals
from turnlake.functions import text as T

FINISH, GIVE_ANSWER, SCAFFOLD = "Finish", "give_answer", "\nBegin!\n"


def conversation_rows(raw: DataFrame) -> DataFrame:
    """Parallel arrays conversations.from and .value to rows (id, pos, role, text)."""
    z = F.arrays_zip(F.col("conversations.from").alias("role"), F.col("conversations.value").alias("text"))
    return raw.select("id", F.posexplode(z).alias("pos", "t")).select("id", "pos", "t.role", "t.text")


def to_arrays(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows back to parallel arrays, in order."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", "text")))
    return rows.groupBy(F.col(key).cast("string").alias("id")).agg(turns.alias("t")).select("id", F.struct(F.col("t.role").alias("from"), F.col("t.text").alias("value")).alias("conversations"))


def shape_reasons(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Per conversation of rows (key, order, role): n_turns and the first broken rule, or 'kept':
    it starts with system or user, ends with assistant, and roles alternate."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("_same", (F.lag("role").over(w) == F.col("role")).cast("int"))
    g = r.groupBy(key).agg(F.count(F.lit(1)).alias("n_turns"), F.min_by("role", order).alias("first"), F.max_by("role", order).alias("last"), F.max("_same").alias("same"))
    reason = F.when(~F.col("first").isin("system", "user"), "bad_first_role").when(F.col("last") != "assistant", "last_not_assistant").when(F.col("same") == 1, "repeated_role").otherwise("kept")
    return g.select(key, "n_turns", reason.alias("reason"))


def funnel(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_turns(df: DataFrame, text: str) -> DataFrame:
    """df plus calls (array<struct<name, arguments>> of a turn's parseable action blocks, in order)
    and thought (its prose)."""
    d = df.withColumn("_b", T.blocks(F.col(text))).withColumn("_a", literals.payloads(F.transform("_b", lambda x: x["raw"])))
    d = d.withColumn("_f", T.read_blocks(F.col("_b"), F.col("_a")))
    return d.select(*df.columns, T.calls_of(F.col("_f")).alias("calls"), T.prose_of(F.col(text), F.col("_f")).alias("thought"))


def converted(raw: DataFrame) -> DataFrame:
    """Raw multi-turn conversations with a drop reason and, where kept, messages, tools (function
    schemas as JSON text) and meta.

    Rules, all must hold: system then user first; assistant last; the list after "APIs:" is a
    non-empty JSON array; each assistant turn has a parseable action, whose last one counts;
    its name is in the list, or Finish in the last assistant turn alone, with give_answer and
    a non-blank answer; a function turn follows a turn with a call; no other roles."""
    c = raw.withColumn("turns", F.arrays_zip(F.col("conversations.from").alias("role"), F.col("conversations.value").alias("text")))
    c = c.withColumn("listed", literals.api_list(F.get("turns", F.lit(0))["text"])).withColumn("tools", literals.tool_schemas(F.col("listed")))
    c = c.withColumn("apis", F.from_json("listed", "array<struct<name: string>>")).withColumn("names", F.col("apis.name"))
    c = c.withColumn("blocks", F.transform("turns", lambda t: F.when(t["role"] == "assistant", T.blocks(t["text"]))))
    c = c.withColumn("arguments", literals.payloads_of_turns(F.transform("blocks", lambda b: F.transform(b, lambda x: x["raw"]))))
    c = c.withColumn("found", F.zip_with("blocks", "arguments", T.read_blocks))
    one = lambda t, f: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.try_element_at(T.calls_of(f), F.lit(-1)).alias("call"), T.prose_of(t["text"], f).alias("thought"))
    parsed = F.zip_with("turns", "found", one)
    c = c.withColumn("p", parsed).withColumn("n", F.size("turns"))
    last_assistant = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.when(F.get("p", i)["role"] == "assistant", i)))
    c = c.withColumn("last", last_assistant)
    c = c.withColumn("finish", F.get("p", F.col("last"))["call"])
    finish, answer = F.col("finish"), F.col("answer")
    c = c.withColumn("answer", F.get_json_object(finish["arguments"], "$.final_answer"))
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(finish["arguments"]), "$.final_answer", "variant")), F.lit("VOID"))
    at = lambda i: F.get("p", i)
    any_turn = lambda test: F.exists(F.sequence(F.lit(0), F.col("n") - 1), test)
    reason = (
        F.when((F.col("n") < 2) | (at(F.lit(0))["role"] != "system") | (at(F.lit(1))["role"] != "user"), "bad_start")
        .when(at(F.col("n") - 1)["role"] != "assistant", "last_not_assistant")
        .when(F.coalesce(F.size("apis"), F.lit(0)) <= 0, "no_api_list")
        .when(any_turn(lambda i: (i > 0) & ~at(i)["role"].isin("user", "assistant", "function")), "unknown_role")
        .when(any_turn(lambda i: (at(i)["role"] == "assistant") & at(i)["call"].isNull()), "unparseable_turn")
        .when(any_turn(lambda i: (i < F.col("last")) & F.coalesce(at(i)["call"]["name"] == FINISH, F.lit(False))), "early_finish")
        .when(any_turn(lambda i: F.coalesce((at(i)["call"]["name"] != FINISH) & ~F.array_contains("names", at(i)["call"]["name"]), F.lit(False))), "unknown_action")
        .when(any_turn(lambda i: (i > 0) & (at(i)["role"] == "function") & ~((at(i - 1)["role"] == "assistant") & F.coalesce(at(i - 1)["call"]["name"] != FINISH, F.lit(False)))), "function_without_call")
        .when(~F.coalesce(finish["name"] == FINISH, F.lit(False)), "no_finish")
        .when(~F.coalesce(F.get_json_object(finish["arguments"], "$.return_type") == GIVE_ANSWER, F.lit(False)), "gave_up")
        .when((F.coalesce(F.btrim(answer), F.lit("")) == "") | (kind != "STRING"), "blank_answer")
        .otherwise("kept")
    )

    def message(t, i):
        first = F.when(i == 0, T.strip_suffix(t["text"], SCAFFOLD)).otherwise(t["text"])
        final = F.btrim(F.concat(t["thought"], F.lit("\n\n"), answer), F.lit(" \n\t\r"))
        is_call = F.coalesce(t["call"]["name"] != FINISH, F.lit(False))
        return F.struct(
            F.when(t["role"] == "function", "tool").otherwise(t["role"]).alias("role"),
            F.when(t["role"] == "user", first).when(t["role"] == "assistant", F.when(is_call, F.nullif(t["thought"], F.lit(""))).otherwise(final)).otherwise(t["text"]).alias("content"),
            F.when(is_call, F.array(t["call"])).alias("tool_calls"),
            F.when(t["role"] == "function", F.get("p", i)["call"]["name"]).alias("name"),
        )

    c = c.withColumn("reason", reason)
    messages = F.transform(F.slice("p", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), message)
    names = F.array_sort(F.array_distinct(F.filter("names", lambda x: x != FINISH)))
    meta = F.struct(T.norm_query(F.col("id")).alias("query"), F.col("n").alias("n_turns_raw"), names.alias("tool_names"), F.btrim(answer, F.lit(" \n\t\r")).alias("final_answer"))
    kept = F.col("reason") == "kept"
    return c.select("id", "reason", F.when(kept, messages).alias("messages"), F.when(kept, F.col("tools")).alias("tools"), F.when(kept, meta).alias("meta"))


def dedupe_first(df: DataFrame, key, order: str) -> DataFrame:
    """Keep the first row in order of each key; order is unique. Keys are dealt as digests and
    pre-aggregated, so neither texts nor a hot key's rows meet in one task."""
    firsts = df.select(F.sha2(key.cast("binary"), 256).alias("_key"), order).groupBy("_key").agg(F.min(order).alias(order))
    return df.join(firsts.select(order), order, "left_semi")


def clean_stats(before: DataFrame, after_filter: DataFrame, kept: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    j = n(before, "raw").crossJoin(n(after_filter, "filtered")).crossJoin(n(kept, "kept"))
    return j.select("raw", "kept", (F.col("raw") - F.col("filtered")).alias("drop_filter"), (F.col("filtered") - F.col("kept")).alias("drop_duplicate"))


def rarity_carve(uses: DataFrame, n_eval: int, distinct_per_example: bool = True) -> dict[str, DataFrame]:
    """uses (example, tool) to eval examples, held-out tools and the pool without any of them.

    An example's score is the sum of its tools' example counts (a repeated tool counts each
    time unless distinct_per_example); the n_eval lowest go to eval, ties by example."""
    pairs = uses.distinct()
    freq = pairs.groupBy("tool").agg(F.count(F.lit(1)).alias("f"))
    scores = (pairs if distinct_per_example else uses).join(freq, "tool").groupBy("example").agg(F.sum("f").alias("score"))
    evals = scores.orderBy("score", "example").limit(n_eval)
    heldout = pairs.join(evals.select("example"), "example", "left_semi").select("tool").distinct()
    touched = pairs.join(heldout, "tool", "left_semi").select("example").distinct()
    pool = pairs.select("example").distinct().join(touched, "example", "left_anti")
    return {"eval": evals, "heldout": heldout, "pool": pool}


def pool_minus(pool: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """pool without taken; a taken key outside the pool is an error."""
    stray = taken.join(pool, key, "left_anti").agg(F.count(F.lit(1)).alias("stray"))
    ok = F.when(F.col("stray") > 0, F.raise_error(F.lit("taken rows outside the pool")).cast("boolean")).otherwise(F.lit(True))
    return pool.join(taken, key, "left_anti").crossJoin(F.broadcast(stray)).where(ok).drop("stray")


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows by the lowest seeded hash: a sample without replacement that reruns agree on."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def numpy_sample(n_rows: int, n: int, seed: int = 42) -> list[int]:
    """Sorted places of a sample without replacement, as numpy's default generator draws them."""
    import numpy as np

    return sorted(np.random.default_rng(seed).choice(n_rows, size=n, replace=False).tolist())


def mixed_contexts(df: DataFrame, key: str, capped: str, share: float, seed: str = "42") -> DataFrame:
    """Rows (source, key) in seeded hash order; source `capped` stops after int(share * all rows)."""
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).cast("bigint").alias("cap"))
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    w = Window.partitionBy("source").orderBy("_h", key)
    ranked = df.withColumn("_h", h).withColumn("_r", F.row_number().over(w)).crossJoin(F.broadcast(n))
    return ranked.where((F.col("source") != capped) | (F.col("_r") <= F.col("cap"))).drop("_h", "_r", "cap")


#: Hashes of queries' n-grams that are sent to every task as a filter; with more, all n-grams are dealt.
FILTERED = 4_000_000


def contamination(queries: DataFrame, corpus: DataFrame, width: int = 5, most: int = FILTERED) -> DataFrame:
    """queries (item_id, text) by corpus (doc_id, text): documents that share a word n-gram, and n-grams shared.
    N-grams are compared by 64-bit hashes; each text's are distinct before they are dealt. Up to
    `most` of the queries' hashes filter the documents' n-grams inside their arrays, so that about
    the matches alone are exploded. Counts the queries' n-grams when called."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        words = df.select(key, F.split(F.lower(T.collapse(F.col("text"))), " ").alias("w"))
        g = F.expr(f"transform(sequence(1, greatest(size(w) - {width - 1}, 1)), i -> xxhash64(slice(w, i, {width})))")
        return words.where(F.size("w") >= width).select(key, F.array_distinct(g).alias("g"))

    # outer: no filter on the arrays is inferred, which would be pushed down and make each n-gram from the text anew
    asked = grams(queries, "item_id").select("item_id", F.explode_outer("g").alias("g"))
    hashes = asked.select("g").distinct()
    found = grams(corpus, "doc_id")
    if hashes.count() <= most:
        found = found.select("doc_id", _among(hashes)("g").alias("g"))
    return asked.join(found.select("doc_id", F.explode_outer("g").alias("g")), "g").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("g").alias("n_grams"))


def _among(hashes: DataFrame):
    """A function of array columns that keeps the elements found among hashes (of a checked number)."""
    known = np.sort(np.array([r[0] for r in hashes.toLocalIterator()], np.int64))
    shared = hashes.sparkSession.sparkContext.broadcast(known)

    def run(arrays: pa.Array) -> pa.Array:
        values, ends = arrays.flatten().to_numpy(zero_copy_only=False), np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = np.searchsorted(shared.value, values)
        hit = np.zeros(len(values), bool)
        if len(shared.value):
            hit = shared.value[np.minimum(at, len(shared.value) - 1)] == values
        before = np.r_[0, np.cumsum(hit)]
        return pa.ListArray.from_arrays(pa.array(before[np.r_[0, ends]], pa.int32()), pa.array(values[hit], pa.int64()))

    # not to be repeated in pushed-down filters
    return arrow_udf(run, "array<bigint>").asNondeterministic()
