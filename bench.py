"""Headline queries, timed one by one; prints one line of JSON.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of cores.  Every
query writes its whole result to a sink that keeps nothing.  Each runs once to
warm up and then three times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from checks import queries as q  # noqa: E402
from checks.compare import session  # noqa: E402
from veil import anonymize  # noqa: E402
from veil.operators.detection import detect_pii  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")


def _spread(spark, folder, name):
    """A test table dealt out to all cores: its file is one piece, which one task would read."""
    return q.table(spark, folder, name).repartition(int(CORES))


def _people(spark, folder):
    """One person per line item: name, e-mail, phone, age, salary, department."""
    number = F.concat(F.lpad((F.col("l_orderkey") + 2000000).cast("string"), 7, "0"), F.lit("555"))
    return _spread(spark, folder, "lineitem").select(
        F.concat(F.lit("Person_"), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.lit("user"), F.col("l_orderkey").cast("string"), F.lit("@company"),
                 F.col("l_suppkey").cast("string"), F.lit(".com")).alias("email"),
        F.concat(F.lit("("), F.substring(number, 1, 3), F.lit(") "), F.substring(number, 4, 3), F.lit("-"),
                 F.substring(number, 7, 4)).alias("phone"),
        (F.col("l_linenumber") * 7 + 18).alias("age"),
        F.col("l_extendedprice").cast("int").alias("salary"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("department"),
    )


def five_methods(spark, folder):
    return anonymize(_people(spark, folder), {
        "name": "hash", "email": "anonymize_email", "phone": "anonymize_phone",
        "age": "generalize_numeric", "salary": q.rule("generalize_numeric", bin_size=10000),
        "department": q.rule("k_anonymity", k=5),
    }, q.SET)


def three_methods(spark, folder):
    policy = {"name": "hash", "email": "anonymize_email", "phone": "anonymize_phone"}
    return anonymize(_people(spark, folder), policy, q.SET)


def hash_lines(spark, folder):
    df = _spread(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return anonymize(df, {c: "hash" for c in df.columns}, q.SET)


def detect_texts(spark, folder):
    return detect_pii(_spread(spark, folder, "documents"), ["text"])


QUERIES = {
    "detect_texts": detect_texts,
    "five_method_policy": five_methods,
    "three_method_policy": three_methods,
    "hash_three_columns": hash_lines,
    **{name: q.QUERIES[name][0] for name in [
        "dp_laplace", "perturb_uniform", "bin_double_negative", "date_strings_mixed", "substitute_type",
        "k_anonymity_orders", "k_anonymity_users", "shuffle_columns", "policy_multi", "job_files",
        "csv_round_trip", "vault_apply", "audit_profile", "audit_privacy",
        "events_daily_k", "stream_policy", "csv_texts", "policy_where", "events_session_k", "stream_session_k",
        "shuffle_composite_key", "vault_collisions", "vault_grows", "category_root", "audit_class_subsets",
        "audit_drift_quantiles_exact", "audit_sketches", "audit_bijection", "audit_report", "detect_types",
        "stream_daily_k",
    ]},
}


def main() -> None:
    spark = session("veil-bench", CORES)
    seconds = {}
    for name, f in QUERIES.items():
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            f(spark, FOLDER).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name:24s} {seconds[name]:8.3f} s", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total seconds of all headline queries", "value": total, "unit": "sec",
        "queries": seconds, "sf": Path(FOLDER).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
