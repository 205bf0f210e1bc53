"""Manifests of frozen files and checks over splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Larger files are hashed in chunks of CHUNK bytes, by a Python worker each.
WHOLE, CHUNK = 64 << 20, 1 << 20


def _streamed(batches):
    """The files' digests, a chunk in memory at a time."""
    import hashlib
    from urllib.parse import urlsplit

    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch["path"]:
            url = urlsplit(path)
            store = fs.LocalFileSystem() if url.scheme in ("", "file") else fs.FileSystem.from_uri(f"{url.scheme}://{url.netloc}/")[0]
            inside = path.partition(":")[2] if url.scheme == "file" else path
            inside = "/" + inside.lstrip("/") if url.scheme in ("", "file") else path.partition("://")[2] if url.scheme.startswith("s3") else url.path
            digest = hashlib.sha256()
            with store.open_input_stream(inside) as f:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of all files under path, by their path within it; contents are hashed
    where they are read: files of up to WHOLE bytes as values, larger ones of any size in chunks."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = listed.where(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = listed.where(F.col("length") > WHOLE).select("path", "length").mapInPandas(_streamed, "path string, length long, sha256 string")
    files = small.unionByName(large)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    within = F.substring(F.regexp_replace("path", r"^[a-z0-9]+:(?://[^/]*)?(?=/)", ""), len(root) + 2, 1 << 30)
    return files.select(F.when(within == "", F.element_at(F.split("path", "/"), -1)).otherwise(within).alias("file"), "sha256", F.col("length").alias("bytes"))


def verify_manifest(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """Problems (check, item): missing, extra, changed sizes or contents."""
    j = frozen.select("file", F.col("sha256").alias("s"), F.col("bytes").alias("b")).join(now, "file", "full_outer")
    p = F.when(F.col("sha256").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.col("sha256"), "checksum")
    return j.select(p.alias("check"), F.col("file").alias("item")).where("check is not null")


def set_checks(spark: SparkSession, *, disjoint=(), subset=(), size=(), non_empty=()) -> DataFrame:
    """One row per check: name, n (violations, or the size), ok.

    disjoint and subset: (name, left, right, key); size: (name, df, n); non_empty: (name, df)."""
    rows = []
    for name, a, b, key in disjoint:
        rows.append(a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("ok")))
    for name, a, b, key in subset:
        rows.append(a.select(key).distinct().join(b.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("ok")))
    for name, df, n in size:
        rows.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == n).alias("ok")))
    for name, df in non_empty:
        rows.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") > 0).alias("ok")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def verify(spark: SparkSession, path: str, frozen: DataFrame, *, disjoint=(), subset=(), size=None, non_empty=(), raw=None) -> DataFrame:
    """All problems (check, item) of frozen sets under path, from the files alone.

    Files against their manifest; then rules over the sets that have all their files (others are
    missing already): disjoint and subset as (left, right, key), size as {set: rows}, non_empty as
    set names; and raw, the manifests of other folders, as {folder: manifest}. A set is a folder
    of Parquet or JSON files under path, as freeze writes them."""
    files = verify_manifest(manifest(spark, path), frozen)
    kinds = {r[0]: r[1] for r in frozen.select(F.split("file", "/")[0], F.regexp_extract("file", r"\.(parquet|json)$", 1).alias("kind")).where("kind <> ''").distinct().collect()}
    gone = {r[0] for r in files.where("check = 'missing'").select(F.split("item", "/")[0]).distinct().collect()}
    there = {k: spark.read.format(v).load(f"{path}/{k}") for k, v in kinds.items() if k not in gone}
    known = lambda *names: all(n in there for n in names)
    rules = {
        "disjoint": [(f"{a} overlaps {b}", there[a], there[b], key) for a, b, key in disjoint if known(a, b)],
        "subset": [(f"{a} not in {b}", there[a], there[b], key) for a, b, key in subset if known(a, b)],
        "size": [(f"rows of {a}", there[a], n) for a, n in (size or {}).items() if known(a)],
        "non_empty": [(f"empty {a}", there[a]) for a in non_empty if known(a)],
    }
    out = files
    if any(rules.values()):
        out = out.unionByName(set_checks(spark, **rules).where("not ok").select("check", F.col("n").cast("string").alias("item")))
    for folder, was in (raw or {}).items():
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            out = out.unionByName(verify_manifest(manifest(spark, folder), was).select(F.concat(F.lit("raw "), "check").alias("check"), "item"))
        else:
            out = out.unionByName(spark.range(1).select(F.lit("raw folder missing").alias("check"), F.lit(folder).alias("item")))
    return out


def fingerprint(files: DataFrame, *params) -> str:
    """One text for a manifest's rows, in any order, and for parameters."""
    h = F.xxhash64("file", "sha256", "bytes")
    r = files.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first()
    return ":".join(map(str, (*r, *params)))


def _mark(spark: SparkSession, path: str, text: str) -> None:
    """A marker appears whole or not at all: it is written under another name and renamed."""
    at, half = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(half, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not fs.rename(half, at):
        raise OSError(f"no marker at {path}")


def resumed(spark: SparkSession, path: str, inputs: str, make) -> DataFrame:
    """The Parquet rows of make() at path. A finished stage with the same inputs (a fingerprint) is
    read back without calling make; one that was cut off, or whose inputs changed, is redone. The
    marker path.done goes before the rows are touched and comes after they are all written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path + ".done")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.exists(at) and "\n".join(r[0] for r in spark.read.text(path + ".done").collect()) == inputs):
        fs.delete(at, False)
        make().write.mode("overwrite").parquet(path)
        _mark(spark, path + ".done", inputs)
    return spark.read.parquet(path)


def freeze(spark: SparkSession, path: str, sets: dict[str, DataFrame], indices: dict[str, DataFrame]) -> DataFrame:
    """Write sets as Parquet and indices (idx) as sorted JSON lines under path, and their
    manifest beside it; then verify it. Any problem is an error. Returns the manifest."""
    for name, df in sets.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    for name, df in indices.items():
        df.select("idx").repartition(1).sortWithinPartitions("idx").write.mode("overwrite").json(f"{path}/{name}")
    manifest(spark, path).coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    frozen = spark.read.schema("file string, sha256 string, bytes long").json(f"{path}.manifest")
    if not (found := verify_manifest(manifest(spark, path), frozen)).isEmpty():
        raise ValueError(f"freeze does not verify: {found.limit(5).collect()}")
    return frozen
