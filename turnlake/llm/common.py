"""Shared pieces: the cluster's shared folder, materialised tables, components."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, as a Java/RE2/Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="turnlake-local-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a session whose executors
    run in the driver's process uses a temp folder of its own; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _local_dir()
    return f"{base.rstrip('/')}/turnlake-{uuid.uuid4().hex}"


def materialize(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: it cuts lineage,
    survives lost executors, and gives later joins real sizes."""
    spark = df.sparkSession
    path = at or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._turnlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no plan needs any more."""
    path = getattr(df, "_turnlake_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a Python worker gets at once: texts can be long.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to BATCH_ROWS where it is larger. Spark reads it when a
    plan runs, so it must stay set; it is the same for every operator, and a session that
    sets a smaller size itself keeps it."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def by_group(rows: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], tuple | None], schema: str) -> DataFrame:
    """work(columns as arrays) -> result columns as arrays, or None, for the rows of each key.
    Groups are cut from sorted batches, so that very many small ones cost little each.
    A group must be of bounded size."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def done(f: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
            cols = {c: f[c].to_numpy() for c in f.columns}
            out = [r for a, b in zip(ends[:-1], ends[1:]) if (r := work({c: v[a:b] for c, v in cols.items()})) is not None]
            return pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*out), strict=True)} if out else {n: [] for n in names})

        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            new = np.zeros(len(f), bool)
            for k in keys:
                v = f[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            if not len(starts):
                rest = f
                continue
            rest = f.iloc[starts[-1] :]
            yield done(f.iloc[: starts[-1]], np.r_[0, starts])
        if rest is not None and len(rest):
            yield done(rest, np.array([0, len(rest)]))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long) edges as (id, component): the smallest
    reachable id. Alternating large-star and small-star steps (Kiveris et al., 2014):
    each step re-links a vertex's neighbours to its smallest one, so hubs become stars
    with aggregates and joins alone; the work tables stay no larger than the edges.
    Ids without an edge are not in the result. Self-loops and repeats are ignored."""

    cur = materialize(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    while True:
        # both joins read written tables on both sides, so that Spark can split a hub's rows
        both, seen = cur.unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u"))), Observation()
        ends = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
        # stars: no vertex has two smaller neighbours, or both a smaller and a larger one
        ends = ends.observe(seen, F.count_if((F.col("below") > 1) | (F.col("below") > 0) & (F.col("above") > 0)).alias("open"))
        low = materialize(ends.select("u", F.least("m", "u").alias("m")))
        if not seen.get.get("open"):
            discard(low)
            break
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        nxt = materialize(large.join(low2, "u").select(F.explode(pair).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        for x in (cur, low, large, low2):
            discard(x)
        cur = nxt
    # every edge now joins a vertex with its component's smallest id
    return cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionAll(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
