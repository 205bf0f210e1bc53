"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def single_parquet(df: DataFrame, path: str, order: str = "ord") -> None:
    """A small, ordered set as one file."""
    df.repartition(1).sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def jsonl(df: DataFrame, path: str, order: str, single: bool = True) -> None:
    """JSON lines in order; one file if single, else range-partitioned files whose names follow the order."""
    out = df.repartition(1).sortWithinPartitions(order) if single else df.repartitionByRange(order).sortWithinPartitions(order)
    out.write.mode("overwrite").json(path)


def generations(df: DataFrame, path: str, expected: int, order: str = "ord") -> None:
    """Generations with token_ids as output_ids; a count other than expected is an error."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} generations for {expected} prompts")
    jsonl(df.withColumnRenamed("token_ids", "output_ids"), path, order)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report_json(report: dict, path: str) -> None:
    """A full report: per_prompt as JSON lines in path, the rest as one line in path.json."""
    per_prompt = report["per_prompt"]
    jsonl(per_prompt, path, "query_id")
    rest = json.dumps({k: v for k, v in report.items() if k != "per_prompt"}, sort_keys=True)
    per_prompt.sparkSession.createDataFrame([(rest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")


def append_samples(samples: DataFrame, path: str) -> None:
    """A log of sampled contexts: micro, source, context and sampled tokens."""
    samples.select("micro", "source", F.size("input_ids").alias("n_ctx_tokens"), "n_sampled").write.mode("append").json(path)


def index_json(df: DataFrame, path: str, column: str = "idx") -> None:
    """A sorted JSON array of a small index on the driver's disk."""
    with open(path, "w") as f:
        json.dump([r[0] for r in df.select(column).orderBy(column).collect()], f)


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = df.select([F.col(c).cast("string") for c in df.columns]).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else x for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
