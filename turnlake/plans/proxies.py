"""Deterministic projections of the driver's tables onto the engine's logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def k_of(props) -> F.Column:
    return F.regexp_extract(props, "([0-9]+)", 1).cast("bigint")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """events as verification events: k decides lengths and acceptance."""
    e = table(spark, sf, "events").withColumn("k", k_of(F.col("props")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n, acc = (1 + F.col("k") % 5).cast("int"), F.least(F.floor(F.col("k") / 5) % (2 + F.col("k") % 5), 1 + F.col("k") % 5).cast("int")
    e = e.select("*", n.alias("n"), acc.alias("acc"), (F.row_number().over(w) - 1).alias("step"))
    return e.select(
        F.col("user_id").cast("string").alias("query_id"), F.lit(None).cast("int").alias("turn"), "step",
        F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: ((F.col("k") * 31 + i) % 1000).cast("int")).alias("draft_tokens"),
        F.concat(F.array_repeat(F.lit(True), F.col("acc")), F.array_repeat(F.lit(False), F.col("n") - F.col("acc"))).alias("accept_mask"),
        F.when(~((F.col("acc") == F.col("n")) & (F.col("event_type") == "purchase")), (F.col("k") * 7).cast("int")).alias("correction_token"),
        F.lit(False).alias("eos"), F.col("value").alias("propose_ms"), (F.col("value") * 0.5 + 1).alias("verify_ms"), "event_type", "event_id", "ts", "k",
    )


EVENTS_SQL = """
ev AS (SELECT CAST(user_id AS VARCHAR) AS query_id, user_id, event_id, ts, event_type, value, k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
    1 + k % 5 AS n, least((k // 5) % (2 + k % 5), 1 + k % 5) AS accepted
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)),
st AS (SELECT *, accepted + CASE WHEN accepted < n THEN 1 ELSE 0 END AS scored,
    CASE WHEN accepted = n AND event_type = 'purchase' THEN 0 ELSE 1 END AS bonus,
    accepted + CASE WHEN accepted = n AND event_type = 'purchase' THEN 0 ELSE 1 END AS emitted FROM ev)
"""

TYPE_CODE = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def type_code() -> F.Column:
    out = F.lit(1)
    for name, code in TYPE_CODE.items():
        out = F.when(F.col("event_type") == name, F.lit(code)).otherwise(out)
    return out


TYPE_CODE_SQL = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 1 END"


def user_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Per user the array of event codes in order."""
    e = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id", type_code().alias("c")).alias("x"))
    return e.groupBy(F.col("user_id").cast("string").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("codes"))


def words(column: str = "text") -> F.Column:
    return F.regexp_extract_all(column, F.lit(r"([^ \t\n\r\f\x0b]+)"), F.lit(1))


WORDS_SQL = r"regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')"


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """events as generations: k decides a valid call, a bad name, an extra or missing key, prose, broken JSON."""
    e = table(spark, sf, "events").withColumn("k", k_of(F.col("props")))
    name = F.when(F.col("k") % 7 == 1, "nope").otherwise(F.col("event_type"))
    args = F.when(F.col("k") % 7 == 2, F.concat(F.lit('{"city": "c'), F.col("k").cast("string"), F.lit('", "zoom": 1}'))).when(F.col("k") % 7 == 3, F.lit('{"unit": "m"}')).otherwise(F.concat(F.lit('{"city": "c'), F.col("k").cast("string"), F.lit('", "unit": "m"}')))
    call = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}"))
    text = (
        F.when(F.col("k") % 7 == 4, F.lit("only prose here")).when(F.col("k") % 7 == 5, F.lit("<call>{broken</call>"))
        .when(F.col("k") % 7 == 6, F.concat(F.lit("two <call>"), call, F.lit(",\n"), call, F.lit("</call> done"))).otherwise(F.concat(F.lit("so <call>"), call, F.lit("</call>")))
    )
    return e.select("event_id", "event_type", "user_id", "k", call.alias("call"), text.alias("text"))
