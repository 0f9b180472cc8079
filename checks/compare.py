"""Run queries and their comparison SQL side by side: python -m checks.compare [folder] [names]."""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def session(name: str = "veil-checks", cores: str = "8", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.sql.adaptive.enabled", "true")
    )
    # On a cluster this names a folder that all executors share.
    conf.setdefault("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="veil-"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True) if len(df.columns) else df


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    """Empty if both hold the same rows in any order."""
    a, b = _sorted(spark_rows), _sorted(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} and {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for c in a.columns:
        kinds = {x.kind if x.kind not in "iu" else x.str for x in (a[c].dtype, b[c].dtype) if hasattr(x, "kind")}
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"{c}: {(~same).sum()} differ, first {a[c][at]!r} and {b[c][at]!r}"
        if len(kinds) > 1:
            return f"{c}: types {a[c].dtype} and {b[c].dtype}"
    return ""


def main() -> int:
    from checks.queries import QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else list(QUERIES)
    spark, con, bad = session(), connect(folder), 0
    for name in names:
        f, sql = QUERIES[name]
        start = time.time()
        try:
            rows = f(spark, folder).toPandas()
            problem = differences(rows, con.execute(sql).df()) if sql else ""
        except Exception as e:  # a failing query must not hide the others
            rows, problem = [], f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:24s} {len(rows):7d} rows {time.time() - start:6.2f}s "
              f"{'' if sql else '(no SQL)'}{problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
