"""Run queries and their SQL on the same tables and compare names and rows.

python tests/oracle_compare.py SF_DIR [NAME...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def compare(spark, con, name, query, sql, sf):
    df = query(spark, sf)
    cols = sorted(df.columns)
    mine = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(canon(r[i]) for i in at) for r in rows)
    if mine != theirs:
        odd = [x for x in zip(mine, theirs) if x[0] != x[1]][:2]
        return f"{len(mine)} and {len(theirs)} rows; first differences {odd}"
    return None if mine else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, q, o = sys.argv[1], e.queries(), e.oracle_sql()
    con, bad = duck(sf), 0
    for name in sys.argv[2:] or [k for k in q if k in o]:
        t = time.time()
        try:
            why = compare(spark, con, name, q[name], o[name], sf)
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:700]}"
        bad += bool(why)
        print(name, f"{time.time() - t:.1f} s", why or "equal", flush=True)
    print("failed:", bad)
