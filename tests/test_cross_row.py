"""k-anonymity, shuffle, lookups and mappings, with skew and awkward keys."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veil import PolicyError, anonymize, temporary_tables
from veil.operators import lookup, mapping, permutation
from veil.operators.suppression import flag_frequent, k_anonymity


def rule(method, **options):
    return {"method": method, "options": options}


def suppress(values, k):
    n = Counter(values)
    return [None if v is None else (str(v) if n[v] >= k else "[SUPPRESSED]") for v in values]


def column(df, name="v"):
    return [r[name] for r in df.orderBy("i").collect()]


KNOWN = ["A"] * 10 + ["B"] * 5 + ["C"] * 3 + ["D"]


@pytest.mark.parametrize("k", [1, 3, 5, 20])
def test_k_anonymity(spark, settings, k):
    values = KNOWN + [None] * 2 + [""] * 4
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert column(anonymize(df, {"v": rule("k_anonymity", k=k)}, settings)) == suppress(values, k)


def skewed(n):
    """A third of one value, a third of nulls, and many small groups."""
    return [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"v{i // 11}") for i in range(n)]


@pytest.mark.parametrize("limit", [lookup.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("k", [2, 4, 10**9])
def test_every_way_back_gives_the_same(spark, limit, k):
    values = skewed(5000)
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    n = Counter(values)
    flagged = flag_frequent(df, ["v"], k, "keep", broadcast_bytes=limit)
    assert column(flagged, "keep") == [n[v] >= k for v in values]
    assert flagged.columns == ["i", "v", "keep"]


@pytest.mark.parametrize("limit", [0, 1000])
def test_hot_keys_do_not_meet_in_one_task(spark, limit):
    """Hot keys are broadcast if they are small enough, else copied to several tasks."""
    df = spark.createDataFrame(list(enumerate(skewed(5000))), "i int, v string")
    table = spark.createDataFrame([("hot", "H"), (None, "N"), *[(f"v{i}", f"L{i}") for i in range(300)]], "v string, label string")
    out = lookup.attach(df, ["v"], table, broadcast_bytes=limit)
    want = {None: "N", "hot": "H", **{f"v{i}": f"L{i}" for i in range(300)}}
    assert column(out, "label") == [want.get(v) for v in skewed(5000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and ("__veil_copy" in plan) == (limit == 0)


def test_long_texts_are_told_apart(spark, settings):
    long = "x" * 5000
    values = [long + "a"] * 3 + [long + "b"] * 2 + ["x" * 71] * 3 + ["x" * 72] * 2
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert column(anonymize(df, {"v": rule("k_anonymity", k=3)}, settings)) == suppress(values, 3)


def test_k_anonymity_types(spark, settings):
    df = spark.createDataFrame([(i, i % 3, 0.5 if i else 1e20, i == 0) for i in range(9)], "i int, a int, b double, c boolean")
    out = anonymize(df, {c: rule("k_anonymity", k=2) for c in "abc"}, settings)
    rows = out.orderBy("i").collect()
    assert [r["a"] for r in rows] == ["0", "1", "2"] * 3
    assert [r["b"] for r in rows] == ["[SUPPRESSED]"] + ["0.5"] * 8
    assert [r["c"] for r in rows] == ["[SUPPRESSED]"] + ["False"] * 8


@pytest.mark.parametrize("limit", [lookup.BROADCAST_BYTES, 0])
def test_quasi_identifiers(spark, limit):
    rows = [(i, i % 4, None if i % 5 == 0 else "p") for i in range(40)] + [(40, 9, "p")]
    df = spark.createDataFrame(rows, "i int, a int, b string")
    n = Counter((a, b) for _, a, b in rows)
    kept = k_anonymity(df, ["a", "b"], 3, drop=True, broadcast_bytes=limit)
    assert sorted(r["i"] for r in kept.collect()) == [i for i, a, b in rows if n[a, b] >= 3]
    out = k_anonymity(df, ["a", "b"], 3, broadcast_bytes=limit).orderBy("i").collect()
    for (i, a, b), r in zip(rows, out):
        assert r["a"] == (str(a) if n[a, b] >= 3 else "[SUPPRESSED]")
        assert r["b"] == (None if b is None else b if n[a, b] >= 3 else "[SUPPRESSED]")
    with pytest.raises(PolicyError):
        k_anonymity(df, ["nope"], 3)


def test_shuffle_keeps_the_values(spark, settings, orders):
    df = orders.select("o_orderkey", "o_totalprice", "o_orderdate", F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"))
    out = anonymize(df, {"p": "shuffle", "o_totalprice": "shuffle"}, settings, ["o_orderkey"])
    assert out.schema["p"].dataType == df.schema["p"].dataType and out.columns == df.columns
    old, new = df.orderBy("o_orderkey").collect(), out.orderBy("o_orderkey").collect()
    assert Counter(r["p"] for r in old) == Counter(r["p"] for r in new)
    assert sorted(r["o_totalprice"] for r in old) == sorted(r["o_totalprice"] for r in new)
    assert [r["o_orderdate"] for r in old] == [r["o_orderdate"] for r in new]
    moved = sum(a["o_totalprice"] != b["o_totalprice"] for a, b in zip(old, new))
    assert moved > 0.98 * len(old)
    pairs = Counter((b["p"], b["o_totalprice"]) for b in new)
    assert pairs != Counter((a["p"], a["o_totalprice"]) for a in old)


def test_shuffle_without_a_row_key(spark, settings):
    df = spark.createDataFrame([(i % 3, i) for i in range(500)], "a int, v int")
    out = anonymize(df, {"v": "shuffle", "a": rule("perturb", range=0)}, settings)
    assert sorted(r["v"] for r in out.collect()) == list(range(500))
    assert out.columns == ["a", "v"]


def test_shuffle_refuses_bad_row_keys(spark, settings):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "i int, v int")
    with pytest.raises(PolicyError, match="unique"):
        anonymize(df, {"v": "shuffle"}, settings, ["i"])
    df = spark.createDataFrame([(1, 1), (None, 2)], "i int, v int")
    with pytest.raises(PolicyError, match="null"):
        anonymize(df, {"v": "shuffle"}, settings, ["i"])
    with pytest.raises(PolicyError):
        anonymize(df, {"v": "shuffle"}, settings, ["nope"])


def test_shuffle_of_nothing(spark, settings):
    df = spark.createDataFrame([], "i int, v int")
    assert anonymize(df, {"v": "shuffle", "i": "k_anonymity"}, settings, ["i"]).count() == 0


def test_ranks_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    ranked, total = permutation.rank_by_key(df.repartition(5), ["k"])
    assert total == 1000
    assert [(r["k"], r["__veil_rank"]) for r in ranked.orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_tasks_of_a_shuffle_hold_so_many_rows(spark, settings, monkeypatch):
    """Larger tables get more partitions than Spark's usual number, 4 here, with the same result."""
    rows = [(i if i % 3 else i % 2 or None, i % 3 > 0, i, i * i) for i in range(3000)]  # keys repeat out of scope
    scoped = spark.createDataFrame(rows, "k int, inside boolean, v int, w int").repartition(6)
    policy = {c: {"method": "shuffle", "where": "inside"} for c in ("v", "w")}
    whole = spark.range(3000).select("id", F.col("id").alias("v"), (F.col("id") % 7).alias("w"))

    def results():
        return (anonymize(whole, {"v": "shuffle", "w": "shuffle"}, settings, ["id"]),
                anonymize(scoped, policy, settings, ["k"]))

    before = [sorted(map(str, df.collect())) for df in results()]
    monkeypatch.setattr(permutation, "_TASK_ROWS", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, wanted in zip(results(), before, strict=True):
            assert sorted(map(str, df.collect())) == wanted
            assert df.rdd.getNumPartitions() == 30
            assert max(df.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) < 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_permutation_looks_uniform(spark, settings):
    """About one value stays in place, and values move a third of the table on average."""
    n = 3000
    df = spark.range(n).select("id", F.col("id").alias("v"))
    out = anonymize(df, {"v": "shuffle"}, settings, ["id"]).collect()
    assert sum(r["id"] == r["v"] for r in out) <= 8
    assert abs(sum(abs(r["id"] - r["v"]) for r in out) / n - n / 3) < n / 20


def test_vault_has_no_collisions(spark, settings):
    left = spark.range(3000).select(F.col("id").alias("a"))
    right = spark.range(2000, 5000).select(F.col("id").cast("string").alias("b"))
    vault = mapping.build_vault([(left, "a"), (right, "b")], settings, width=4).cache()
    rows = vault.collect()
    assert len(rows) == 5000 == len({r["code"] for r in rows}) == len({r["value"] for r in rows})
    assert any(r["widened"] for r in rows)
    codes = {r["value"]: r["code"] for r in rows}
    with pytest.raises(PolicyError):
        mapping.build_vault([(left, "a")], settings, width=2)
    hot = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(600)] + [(600, None)], "i int, v int")
    got = column(mapping.apply_vault(hot, "v", vault, settings))
    assert got == [codes[str(7 if i % 3 else i)] for i in range(600)] + [None]


def test_vault_codes_of_unseen_values(spark, settings):
    known = spark.range(3000).select(F.col("id").alias("a"))
    vault = mapping.build_vault([(known, "a")], settings, width=4)
    got = column(mapping.apply_vault(spark.range(20000).selectExpr("id AS i", "id AS v"), "v", vault, settings))
    assert len(set(got)) == 20000
    assert all(len(c) == len("ID_") + 64 for c in got[3000:])


def test_dictionary(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text('{\n "Acme": "Company A",\n "Beta \\"B\\"": "Company B"\n}')
    table = mapping.read_dictionary(spark, str(path))
    df = spark.createDataFrame(list(enumerate(["Acme", 'Beta "B"', "Other", None])), "i int, v string")
    assert column(mapping.map_values(df, "v", table)) == ["Company A", "Company B", "[REDACTED]", None]
    assert column(mapping.map_values(df, "v", table, "else")) == ["Company A", "Company B", "else", None]
    with pytest.raises(PolicyError):
        mapping.map_values(df, "v", table.union(table))


def test_hierarchy(spark):
    tree = spark.createDataFrame([("cat", "mammal"), ("mammal", "animal"), ("animal", "thing")], "value string, parent string")
    df = spark.createDataFrame(list(enumerate(["cat", "mammal", "stone", None])), "i int, v string")
    assert column(mapping.generalize_category(df, "v", tree)) == ["mammal", "animal", "[REDACTED]", None]
    assert column(mapping.generalize_category(df, "v", tree, 2)) == ["animal", "thing", "[REDACTED]", None]
    assert column(mapping.generalize_category(df, "v", tree, 9)) == ["thing", "thing", "[REDACTED]", None]


def test_stored_tables_can_be_deleted(spark, settings, orders, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    with temporary_tables(spark):
        out = anonymize(orders, {"o_orderdate": "k_anonymity", "o_orderpriority": "shuffle"}, settings, ["o_orderkey"])
        out.write.parquet(str(tmp_path / "out"))
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == orders.count()
