"""Validated scans. Order is explicit: files are read with column ord where rows have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake import schemas
from turnlake.functions import text as T
from turnlake.operators import metrics


def _not_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no records in {what}")
    return df


def records(spark: SparkSession, path: str, limit: int | None = None, order: str = "ord") -> DataFrame:
    """Parquet records, the first limit in order; an empty source is an error."""
    df = spark.read.parquet(path)
    if limit is not None:
        df = df.orderBy(order).limit(limit)
    return _not_empty(df, path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """Event JSONL; a malformed line, a broken rule or an empty file is an error; blank lines are skipped."""
    df = spark.read.schema(schemas.EVENT).option("mode", "FAILFAST").json(path)
    return metrics.validated(_not_empty(df, path))


def generations(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(schemas.GENERATION).option("mode", "FAILFAST").json(path)
    ok = F.col("query_id").isNotNull() & (F.size("output_ids") > 0) & (F.col("logprobs").isNull() | (F.size("logprobs") == F.size("output_ids")))
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("malformed generation")).cast("boolean")))


def outputs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OUTPUT).json(path)


def bench_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Metrics JSONL of kind bench plus k. Not strict: junk before a line's first brace is dropped."""
    if strict:
        df = spark.read.schema(schemas.BENCH).option("mode", "FAILFAST").json(path)
    else:
        lines = spark.read.text(path).select(F.from_json(T.repair_json_line(F.col("value")), schemas.BENCH).alias("r"))
        df = lines.where("r is not null").select("r.*")
    return _not_empty(df.where("kind = 'bench'"), path).withColumn("k", F.col("spec_config.num_speculative_tokens"))


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ids to (idx, ord)."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", "array<bigint>").alias("a"))
    return whole.select(F.posexplode("a").alias("ord", "idx")).select("idx", "ord")


def pool(single: DataFrame, multi: DataFrame) -> DataFrame:
    """Two context pools as one, tagged by source."""
    return single.withColumn("source", F.lit("single")).unionByName(multi.withColumn("source", F.lit("multi")), allowMissingColumns=True)


def catalog_report(tables: dict[str, DataFrame]) -> list[tuple[str, list[str], int]]:
    return [(name, df.columns, df.count()) for name, df in tables.items()]
