"""Acceptance metrics over a stream of event files (an extension: totals as files arrive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnlake import schemas
from turnlake.operators import metrics


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT).json(path)


def running_totals(events: DataFrame) -> DataFrame:
    """Per prompt: additive totals, from which all rates follow; state is one row per prompt."""
    stats = metrics.event_stats(events)
    return stats.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_steps"), F.sum("scored").alias("n_scored"), F.sum("accepted").alias("n_accepted"), F.sum("bonus").alias("n_bonus"), F.sum("emitted").alias("n_emitted"))


def start(totals: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
