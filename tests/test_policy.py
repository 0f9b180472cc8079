"""The policy language, the table operator and what must hold for any plan."""

import json

import pytest
from pyspark.sql import functions as F

from veil import Policy, PolicyError, Settings, TablePolicy, anonymize, preview
from veil.plans.job import anonymize_tables, methods
from veil.plans.presets import PRESETS, preset


def rule(method, **options):
    return {"method": method, "options": options}


FULL = {
    "o_custkey": "pseudonymize",
    "o_orderstatus": rule("substitute", list=["x", "y"]),
    "o_totalprice": "differential_privacy",
    "o_orderdate": "k_anonymity",
    "o_orderpriority": "shuffle",
}


def rows(df):
    return sorted(map(str, df.collect()))


def test_short_and_long_rules(spark, settings, orders):
    want = rows(anonymize(orders, {"o_custkey": "hash"}, settings))
    for written in ({"method": "hash", "options": {}}, {"method": "hash"}, {}, {"options": None}, "Hash", "no such method"):
        assert rows(anonymize(orders, {"o_custkey": written}, settings)) == want


def test_names_of_methods(spark, settings, orders):
    assert TablePolicy.of({"o_custkey": "K-Anonymity"}).resolve(orders.schema)[0].method.name == "k_anonymity"
    assert TablePolicy.of({"o_custkey": "Anonymize SSN"}).resolve(orders.schema)[0].method.name == "anonymize_ssn"
    assert anonymize(orders, {"o_custkey": "None"}, settings).schema == orders.schema
    note = TablePolicy.of({"o_custkey": "scramble"}).resolve(orders.schema)[0].note
    assert "scramble" in note


def test_order_of_columns_and_removal(spark, settings, orders):
    out = anonymize(orders, {**FULL, "o_totalprice": "remove"}, settings, ["o_orderkey"])
    assert out.columns == [c for c in orders.columns if c != "o_totalprice"]
    assert orders.columns[3] == "o_totalprice"


@pytest.mark.parametrize("bad", [
    {"nope": "hash"},
    {"o_custkey": rule("hash", algorithm="crc")},
    {"o_custkey": rule("hash", algoritm="md5")},
    {"o_custkey": rule("generalize_numeric", bin_size=0)},
    {"o_custkey": rule("generalize_numeric", bin_size=2.5)},
    {"o_custkey": rule("generalize_date")},
    {"o_orderdate": rule("generalize_date", granularity="week")},
    {"o_orderdate": rule("generalize_date", on_error="ignore")},
    {"o_totalprice": rule("differential_privacy", epsilon=0)},
    {"o_totalprice": rule("differential_privacy", mechanism="other")},
    {"o_totalprice": rule("perturb", range=-1)},
    {"o_totalprice": rule("perturb", type="percentage", percentage=None)},
    {"o_custkey": rule("k_anonymity", k=0)},
    {"o_custkey": rule("mask", mask_char="")},
    {"o_custkey": rule("substitute", list="abc")},
    {"o_orderpriority": "differential_privacy"},
    {"o_custkey": 7},
    {"o_custkey": {"method": 7}},
])
def test_bad_rules_are_found_before_anything_runs(orders, settings, bad):
    with pytest.raises(PolicyError):
        anonymize(orders, bad, settings, ["o_orderkey"])


def test_no_job_runs_before_the_last_rule_is_checked(spark, settings, orders):
    spark.sparkContext.setJobGroup("checked first", "")
    nested = orders.withColumn("a", F.array("o_custkey"))
    for bad in ({"o_totalprice": "generalize_date"}, {"a": "k_anonymity"}, {"a": "hash"}):
        with pytest.raises(PolicyError):
            anonymize(nested, {"o_orderdate": "k_anonymity", "o_custkey": "shuffle", **bad}, settings)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("checked first")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_lenient_columns(spark, orders):
    relaxed = Settings("s", "k", strict=False)
    assert anonymize(orders, {"nope": "hash", "o_custkey": rule("hash", x=1)}, relaxed).columns == orders.columns


def test_policy_text(orders):
    text = json.dumps({"orders": {"o_custkey": "hash"}})
    assert Policy.of(text).table("orders").rules["o_custkey"].method == "hash"
    assert Policy.of(text).table("other").rules == {}
    for bad in ("{", "[]", "{}", {}, 5):
        with pytest.raises(PolicyError):
            Policy.of(bad)


def test_keys_need_equal_rules():
    same = {"a": {"k": "hash"}, "b": {"j": {"method": "hash"}}}
    Policy.of(same).check_keys([("a.k", "b.j")])
    Policy.of({"a": {"x": "hash"}}).check_keys([("a.k", "b.j")])
    for other in ("pseudonymize", "shuffle", "substitute", "none", rule("hash", algorithm="md5")):
        with pytest.raises(PolicyError):
            Policy.of({"a": {"k": "hash"}, "b": {"j": other}}).check_keys([("a.k", "b.j")])
    with pytest.raises(PolicyError):
        Policy.of({"a": {"k": "perturb"}, "b": {"j": "perturb"}}).check_keys([("a.k", "b.j")])


def test_settings():
    assert "pepper" not in repr(Settings("pepper", "kk")) and "kk" not in repr(Settings("pepper", "kk"))
    assert Settings("a").key != Settings("a").key
    for bad in ("", None):
        with pytest.raises(PolicyError):
            Settings(bad)


def test_salt_separates(spark, orders):
    a = anonymize(orders, {"o_custkey": "hash"}, Settings("one", "k")).select("o_custkey").distinct()
    b = anonymize(orders, {"o_custkey": "hash"}, Settings("two", "k")).select("o_custkey").distinct()
    assert a.join(b, "o_custkey").count() == 0


def test_equal_values_stay_equal_across_columns(spark, settings):
    df = spark.createDataFrame([("j@c.com", "j@c.com", 5, "5")], "a string, b string, c int, d string")
    row = anonymize(df, {"a": "anonymize_email", "b": "anonymize_email", "c": "hash", "d": "hash"}, settings).first()
    assert row["a"] == row["b"] and row["c"] == row["d"]


def test_odd_column_names(spark, settings):
    df = spark.createDataFrame([(1, "x", 2)], "`a.b` int, `c d` string, `e``f` int")
    out = anonymize(df, {"a.b": "hash", "c d": "k_anonymity", "e`f": "shuffle"}, settings, ["a.b"])
    assert out.columns == ["a.b", "c d", "e`f"] and out.count() == 1


def test_partitioning_and_order_do_not_matter(spark, settings, orders):
    want = rows(anonymize(orders, FULL, settings, ["o_orderkey"]))
    for df in (orders.repartition(7), orders.orderBy(F.desc("o_totalprice")), orders.coalesce(1)):
        assert rows(anonymize(df, FULL, settings, ["o_orderkey"])) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows(anonymize(orders, FULL, settings, ["o_orderkey"])) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_row_methods_do_not_depend_on_chunks(spark, settings, orders):
    policy = {"o_custkey": "hash", "o_totalprice": "perturb", "o_orderdate": "generalize_date"}
    whole = rows(anonymize(orders, policy, settings, ["o_orderkey"]))
    parts = [anonymize(orders.filter(f"o_orderstatus {op} 'F'"), policy, settings, ["o_orderkey"]) for op in ("=", "<>")]
    assert rows(parts[0].unionByName(parts[1])) == whole


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().toString()


def test_plans(spark, orders):
    secret = Settings("s3cr3t-pepper", "s3cr3t-draws")
    out = anonymize(orders, FULL, secret, ["o_orderkey"])
    plan = plan_of(out)
    assert "s3cr3t" not in plan
    assert "SinglePartition" not in plan and "Python" not in plan and "CartesianProduct" not in plan
    row_only = anonymize(orders, {"o_custkey": "hash", "o_totalprice": "remove", "o_orderstatus": "mask"}, secret)
    plan = row_only._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "o_totalprice" not in scan.split("ReadSchema")[1]


def test_preview(spark, settings, orders):
    shown = preview(orders, {"o_orderdate": "k_anonymity"}, settings, 5)
    whole = {str(r) for r in anonymize(orders, {"o_orderdate": "k_anonymity"}, settings).collect()}
    got = shown.collect()
    assert len(got) == 5 and {str(r) for r in got} <= whole


def test_catalogue(spark):
    listed = {r["method"]: r for r in methods(spark).collect()}
    assert len(listed) >= 14
    assert not listed["shuffle"]["streaming_safe"] and listed["hash"]["deterministic"]


def test_presets(spark, settings):
    for name, rules in PRESETS.items():
        TablePolicy.of(preset(name, {r: r for r in rules}))
    df = spark.createDataFrame(
        [("P001", "1990-01-15", "Asthma", "12345"), ("P002", "1985-05-20", "Flu", "67890")],
        "pid string, dob string, why string, zip string",
    )
    roles = {"pid": "record_number", "dob": "birth_date", "why": "finding", "zip": "postal_code"}
    out = anonymize(df, preset("hipaa", roles), settings).collect()
    assert [r["dob"] for r in out] == ["1990", "1985"] and out[0]["zip"] == "12300-12399"
    assert out[0]["pid"].startswith("REC_") and out[0]["why"] == "Asthma"
    with pytest.raises(PolicyError):
        preset("hipaa", {"x": "no role"})


def test_tables_share_salt_and_key(spark, settings, sf):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("customer", "orders")}
    policy = {"customer": {"c_custkey": "hash"}, "orders": {"o_custkey": "hash"}}
    out = anonymize_tables(tables, policy, settings)
    before = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).count()
    assert out["orders"].join(out["customer"], F.col("o_custkey") == F.col("c_custkey")).count() == before
    with pytest.raises(PolicyError):
        anonymize_tables(tables, {"orders": {}}, settings, require_all_tables=True)
    with pytest.raises(PolicyError):
        anonymize_tables(tables, {"typo": {}}, settings)


def test_names_in_another_case_are_the_same_column(spark, settings):
    df = spark.createDataFrame([("a",)], "Name string")
    loose = Settings(settings.salt, settings.key, strict=False)
    assert len(anonymize(df, {"name": "hash"}, loose).first()["Name"]) == 64
    with pytest.raises(PolicyError):
        anonymize(df, {"name": "hash", "NAME": "mask"}, settings)


def test_rules_for_some_rows(spark, settings):
    df = spark.createDataFrame(
        [(1, "EU", "anna", 1.5), (2, "US", "bob", 2.5), (3, None, "carl", None), (4, "EU", None, 4.0), (5, "EU", "anna", 5.0)],
        "id int, `re gion` string, name string, pay double")
    eu = "`re gion` = 'EU'"
    policy = json.dumps({"t": {
        "name": {"method": "mask", "where": eu}, "pay": {"method": "generalize_numeric", "where": f"{eu} AND pay > 2"},
        "re gion": {"method": "k_anonymity", "options": {"k": 2}, "where": "id < 5"}}})
    out = anonymize_tables({"t": df}, policy, settings)["t"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (1, "EU", "****", "1.5"), (2, "[SUPPRESSED]", "bob", "2.5"), (3, None, "carl", None), (4, "EU", None, "0-9"),
        (5, "EU", "****", "0-9")]


def test_a_condition_may_name_a_removed_column(spark, settings):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b"), (3, "y", "c"), (4, "y", "d")], "id int, kind string, name string")
    out = anonymize(df, {"kind": "remove", "name": {"method": "shuffle", "where": "kind = 'y'"}}, settings, ["id"])
    rows = {r["id"]: r["name"] for r in out.collect()}
    assert out.columns == ["id", "name"] and rows[1] == "a" and sorted(rows.values()) == ["a", "b", "c", "d"]
    numbered = anonymize(df, {"name": {"method": "shuffle", "where": "kind = 'y'"}}, settings)
    assert {r["id"]: r["name"] for r in numbered.collect()}[1] == "a"


@pytest.mark.parametrize("rule", [
    {"method": "remove", "where": "id = 1"}, {"method": "mask", "where": "nothing = 1"}, {"method": "mask", "where": "id"},
    {"method": "mask", "where": "rand() < 0.5"}, {"method": "mask", "where": "id = = 1"}, {"method": "mask", "where": 1}])
def test_bad_conditions(spark, settings, rule):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    with pytest.raises(PolicyError):
        anonymize(df, {"name": rule}, settings)


def test_keys_take_no_condition():
    written = {"a": {"k": {"method": "hash", "where": "k > 1"}}, "b": {"k": "hash"}}
    with pytest.raises(PolicyError, match="some rows"):
        Policy.of(written).check_keys([("a.k", "b.k")])
