"""Audits find what was planted."""

import math

import pytest
from pyspark.sql import functions as F

from veil import anonymize
from veil.operators import audit, detection


def rule(method, **options):
    return {"method": method, "options": options}


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i int, v string")
    got = by_column(audit.profile(df))
    assert got["v"].asDict() == {"column": "v", "rows": 4, "nulls": 1, "distinct": 2, "min_group": 1,
                                 "max_group": 2, "unique_share": 0.25}
    assert got["i"]["unique_share"] == 1.0
    near = by_column(audit.approx_profile(df))
    assert near["v"]["nulls"] == 1 and near["i"]["approx_distinct"] == 4
    assert [tuple(r) for r in audit.frequencies(df, "v").collect()] == [("a", 2), ("b", 1)]


def test_uniqueness(spark, settings, orders):
    before = orders.select("o_orderkey")
    good = anonymize(before, {"o_orderkey": "hash"}, settings)
    bad = anonymize(before, {"o_orderkey": rule("pseudonymize", length=2)}, settings)
    assert audit.uniqueness(before, good, ["o_orderkey"]).first()["kept"]
    found = audit.uniqueness(before, bad, ["o_orderkey"]).first()
    assert not found["kept"] and found["distinct_after"] <= 256


def test_drift(spark, settings, orders):
    near = anonymize(orders, {"o_totalprice": rule("perturb", type="gaussian", range=500)}, settings, ["o_orderkey"])
    far = orders.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    assert audit.drift(orders, near, ["o_totalprice"]).first()["within"]
    assert not audit.drift(orders, far, ["o_totalprice"]).first()["within"]
    parts = audit.drift(orders, near, ["o_totalprice"], ["o_orderstatus"]).collect()
    assert len(parts) == orders.select("o_orderstatus").distinct().count()


def test_drift_of_null_and_lost_segments(spark):
    before = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 1.0), ("a", 3.0)], "g string, v double")
    after = spark.createDataFrame([(None, 1.0), (None, 3.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = {r["g"]: (r["mean_before"], r["mean_after"], r["within"])
           for r in audit.drift(before, after, ["v"], ["g"]).collect()}
    assert got == {None: (2.0, 2.0, True), "a": (2.0, None, False), "b": (None, 2.0, False)}


def test_rows_without_a_partner(spark):
    before = spark.createDataFrame([(i, float(i)) for i in range(6)], "i int, v double")
    after = spark.createDataFrame([(4, 4.0), (5, 6.0), (6, 6.0)], "i int, v double")
    got = audit.leaks(before, after, ["i"], ["v"]).first()
    assert (got["values"], got["unchanged"], got["missing_rows"], got["extra_rows"]) == (2, 1, 4, 1)
    got = audit.noise(before, after, ["i"], ["v"]).first()
    assert (got["values"], got["max_noise"], got["missing_rows"], got["extra_rows"]) == (2, 1.0, 4, 1)


def test_links(spark, settings):
    child = spark.createDataFrame([(1,)] * 50 + [(2,), (3,), (3,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (2,), (5,)], "k int")
    assert audit.links(child, "k", parent, "k").first().asDict() == {
        "rows": 53, "keys": 3, "orphan_rows": 2, "orphan_keys": 1}
    hashed = audit.links(
        anonymize(child, {"k": "hash"}, settings), "k", anonymize(parent, {"k": "hash"}, settings), "k").first()
    assert hashed["orphan_rows"] == 2


def test_relationships(spark, settings):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "a int, b int")
    good = anonymize(df, {"a": "hash", "b": "hash"}, settings)
    bad = anonymize(df, {"a": "hash", "b": "pseudonymize"}, settings)
    assert audit.relationships(df, good, "a", "b").first()["kept"]
    assert not audit.relationships(df, bad, "a", "b").first()["kept"]


def test_leaks(spark):
    before = spark.createDataFrame([(1, "123-45-6789"), (2, "555-1234"), (3, "x"), (4, None)], "i int, v string")
    after = spark.createDataFrame([(1, "900-45-6780"), (2, "555-1234"), (3, "y"), (4, None)], "i int, v string")
    got = audit.leaks(before, after, ["i"], ["v"], digits=4).first()
    assert (got["values"], got["unchanged"], got["digit_runs"]) == (3, 1, 2)
    assert audit.leaks(before, after, ["i"], ["v"]).first()["digit_runs"] == 0


def test_noise(spark, settings):
    before = spark.range(2000).select("id", F.lit(100.0).alias("v"))
    after = anonymize(before, {"v": rule("perturb", range=10)}, settings, ["id"])
    got = audit.noise(before, after, ["id"], ["v"]).first()
    assert -10 <= got["min_noise"] < -9 and 9 < got["max_noise"] <= 10
    assert abs(got["mean_noise"]) < 1 and abs(got["std_noise"] - 20 / math.sqrt(12)) < 0.5


def test_k_threshold(spark, settings):
    df = spark.createDataFrame([(v,) for v in "aaaabbc"] + [(None,)], "v string")
    assert not audit.k_threshold(df, ["v"], 3).first()["holds"]
    done = anonymize(df, {"v": rule("k_anonymity", k=3)}, settings)
    got = audit.k_threshold(done, ["v"], 3).first()
    assert got["holds"] and got["values"] == 1 and got["min_group"] == 4
    none = audit.k_threshold(anonymize(df, {"v": rule("k_anonymity", k=9)}, settings), ["v"], 9).collect()
    assert [r.asDict() for r in none] == [
        {"column": "v", "values": 0, "min_group": None, "below_k": 0, "holds": True}]


def test_classes(spark):
    df = spark.createDataFrame([(1, "a", 7), (1, "a", 8), (1, "b", 7), (2, "b", 7)], "q int, r string, s int")
    sizes = {r["size"]: (r["classes"], r["rows"]) for r in audit.class_sizes(df, ["q", "r"]).collect()}
    assert sizes == {2: (1, 2), 1: (2, 2)}
    got = audit.privacy_report(df, ["q", "r"], "s").first().asDict()
    assert got == {"rows": 4, "classes": 3, "min_class": 1, "max_class": 2, "unique_rows": 2, "max_risk": 1.0,
                   "mean_risk": 0.75, "min_diversity": 1}
    subsets = {r["left_out"]: (r["classes"], r["min_class"]) for r in audit.class_sizes_by_subset(df, ["q", "r"]).collect()}
    assert subsets == {0: (3, 1), 1: (2, 1), 2: (2, 2), 3: (1, 4)}


@pytest.mark.parametrize("text,kinds", [
    ("write to a.b@c.org now", {"email"}),
    ("@handle and 5 @ 6", set()),
    ("call (555) 123-4567", {"phone"}),
    ("call 555.123.4567.", {"phone"}),
    ("no 1555-123-45678", set()),
    ("123-45-6789", {"ssn"}),
    ("9123-45-6789", set()),
    ("1234 5678 9012 3456", {"card"}),
    ("1234567890123456", {"card"}),
    ("12345678901234567", set()),
    ("on 2023-05-15 or", {"date"}),
    ("12/31/1999", {"date"}),
    ("112/31/1999", set()),
])
def test_detection(spark, text, kinds):
    df = spark.createDataFrame([(text,), (None,)], "v string")
    got = {r["kind"] for r in detection.detect_pii(df).collect() if r["hits"]}
    assert got == kinds


def test_suggested_policy(spark, settings):
    rows = [(i, f"u{i}@x.org", f"555-123-{1000 + i}", "words") for i in range(20)]
    df = spark.createDataFrame(rows, "i int, m string, p string, w string")
    policy = detection.suggest_policy(df)
    assert policy == {"m": "anonymize_email", "p": "anonymize_phone"}
    assert anonymize(df, policy, settings).count() == 20
    assert detection.detect_pii(df.select("i")).count() == 0
