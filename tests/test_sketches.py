"""Sketches against exact figures, exact quantiles against a sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veil import PolicyError
from veil.operators import sketches as sk


@pytest.fixture(scope="module")
def values(spark):
    """A segment with most of the rows, equal values, nulls and values that are no numbers."""
    rng = random.Random(4)
    rows = []
    for i in range(6000):
        segment = rng.choice(["big"] * 8 + ["small", None])
        x = rng.choice([None, float("nan"), 1.0, rng.gauss(100, 15), rng.gauss(100, 15), float(rng.randrange(5))])
        rows.append((i, segment, x, rng.randrange(40)))
    rows += [(6000, "empty", None, None), (6001, "one", 7.5, 1)]
    return rows, spark.createDataFrame(rows, "id int, seg ment string, x double, `n.n` int".replace("seg ment", "`seg ment`")).repartition(7)


def nearest_rank(rows, at):
    out = {}
    for segment in {r[1] for r in rows}:
        for column, i in (("x", 2), ("n.n", 3)):
            found = sorted(float(r[i]) for r in rows if r[1] == segment and r[i] is not None and not math.isnan(r[i]))
            for q in at:
                if found:
                    out[segment, column, q] = found[max(1, math.ceil(q * len(found))) - 1]
    return out


def test_exact_quantiles(values):
    rows, df = values
    at = [0.0, 0.05, 0.25, 0.5, 0.99, 1.0]
    got = {(r["seg ment"], r["column"], r["quantile"]): r["value"]
           for r in sk.exact_quantiles(df, ["x", "n.n"], ["seg ment"], at).collect()}
    assert got == nearest_rank(rows, at)


def test_merged_quantiles_keep_to_their_error(values):
    rows, df = values
    at = [0.05, 0.5, 0.95]
    chunks = [sk.quantile_sketches(df.filter(F.col("id") % 3 == i), ["x", "n.n"], ["seg ment"], 200) for i in range(3)]
    merged = sk.merge_quantiles(chunks, ["seg ment"], 200)
    found = sk.estimated_quantiles(merged, at).collect()
    assert {(r["seg ment"], r["column"], r["quantile"]) for r in found} == set(nearest_rank(rows, at))
    for r in found:
        i = 2 if r["column"] == "x" else 3
        known = [v[i] for v in rows if v[1] == r["seg ment"] and v[i] is not None and not math.isnan(v[i])]
        low, high = (sum(test(v) for v in known) / len(known) for test in (r["value"].__gt__, r["value"].__ge__))
        error = 2 * sk.rank_error(200) + 1 / len(known)
        assert low <= r["quantile"] + error and high >= r["quantile"] - error


@pytest.mark.parametrize("exact", [True, False])
def test_quantile_drift(spark, exact):
    before = spark.createDataFrame([("a", float(i)) for i in range(1000)] + [("gone", 1.0), ("flat", 2.0), ("flat", 2.0)],
                                   "s string, x double")
    after = before.filter("s != 'gone'").withColumn("x", F.expr("IF(s = 'a' AND x > 900, x + 400, x)"))
    after = after.unionByName(spark.createDataFrame([("new", 1.0)], "s string, x double"))
    out = {(r["s"], r["quantile"]): r for r in sk.quantile_drift(before, after, ["x"], ["s"], exact=exact).collect()}
    assert len(out) == 12
    assert out["a", 0.5]["within"] and not out["a", 0.95]["within"]
    assert out["a", 0.95]["shift"] == pytest.approx(0.8, abs=0.1)
    assert out["flat", 0.5]["within"] and out["flat", 0.5]["shift"] == 0
    assert not out["gone", 0.5]["within"] and out["gone", 0.5]["after"] is None
    assert not out["new", 0.5]["within"] and out["new", 0.5]["before"] is None


def test_stored_sketches_compare_without_the_values(spark, tmp_path):
    before = spark.range(5000).selectExpr("id", "cast(id AS double) AS x", "id % 2 AS day")
    sk.quantile_sketches(before, ["x"], ["day"]).write.parquet(str(tmp_path / "q"))
    stored = spark.read.parquet(str(tmp_path / "q"))
    out = sk.quantile_drift(stored, sk.quantile_sketches(before.withColumn("x", F.col("x") * 2), ["x"]), ["x"])
    assert {r["within"] for r in out.collect()} == {False}
    assert {r["within"] for r in sk.quantile_drift(stored, before, ["x"]).collect()} == {True}


def test_distinct_sketches_merge(spark):
    df = spark.range(3000).selectExpr("id", "id % 700 AS a", "IF(id % 5 = 0, NULL, concat('v', id)) AS b", "id % 3 AS chunk")
    chunks = [sk.distinct_sketches(df.filter(F.col("chunk") == c), ["id", "a", "b"]) for c in range(3)]
    profile = {r["column"]: r for r in sk.estimated_profile(sk.merge_distinct(chunks)).collect()}
    # Below the size of a sketch the counts are exact.
    assert {c: (r["rows"], r["nulls"], r["distinct"]) for c, r in profile.items()} == {
        "id": (3000, 0, 3000), "a": (3000, 0, 700), "b": (3000, 600, 2400)}
    small = {r["column"]: r["distinct"] for r in sk.estimated_profile(sk.distinct_sketches(df, bits=8)).collect()}
    assert abs(small["id"] - 3000) <= 3000 * sk.distinct_error(8)
    by = sk.merge_distinct([sk.distinct_sketches(df, ["a"], ["chunk"])], ["chunk"])
    assert {r["rows"] for r in by.collect()} == {1000} and by.columns == ["chunk", "column", "rows", "nulls", "sketch"]
    with pytest.raises(PolicyError):
        sk.merge_distinct([])


def test_uniqueness_and_overlap_of_sketches(spark):
    df = spark.range(40000).selectExpr("id", "id % 100 AS few", "id AS other")
    old = sk.distinct_sketches(df, bits=12)
    new = sk.distinct_sketches(df.selectExpr("id % 20000 AS id", "few % 99 AS few", "id + 20000 AS extra"), bits=12)
    kept = {r["column"]: r["kept"] for r in sk.estimated_uniqueness(old, new, 12).collect()}
    assert kept == {"id": False, "few": False, "other": False, "extra": False}
    same = {r["column"]: r["kept"] for r in sk.estimated_uniqueness(old, old, 12).collect()}
    assert set(same.values()) == {True}
    shared = {(r["column"], r["other"]): r["shared"] for r in sk.estimated_overlap(old, new).collect()}
    assert shared["few", "few"] == 99
    assert abs(shared["id", "extra"] - 20000) <= 60000 * sk.distinct_error(12)
