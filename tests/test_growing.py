"""Vaults that grow, hierarchies of any depth, keys that correspond one to one."""

import random

import pytest

from veil import PolicyError, Settings
from veil.operators import audit, mapping

SET = Settings("s", "k")


def words(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string"), "v"


def codes(vault):
    return {r["value"]: (r["code"], r["version"]) for r in vault.collect()}


def test_old_codes_stay(spark, tmp_path):
    path = str(tmp_path / "vault")
    known = {}
    for version, end in enumerate((300, 300, 3000, 9000), 1):
        values = [f"v{i}" for i in range(end)] + [None, "v1", "v1"]
        vault = mapping.grow_vault(spark, path, [words(spark, *values), words(spark, "other")], SET, width=4)
        now = codes(vault)
        assert len(now) == end + 1 == vault.count()
        assert known.items() <= now.items()
        assert len({code for code, _ in now.values()}) == len(now)
        known = now
    assert {v for _, v in known.values()} == {1, 2, 3}  # the second run had nothing new
    assert len({len(code) for code, _ in known.values()}) > 1
    assert codes(mapping.read_vault(spark, path, 1)) == {k: c for k, c in known.items() if c[1] == 1}
    with pytest.raises(PolicyError, match="no version"):
        mapping.read_vault(spark, path, 9)


def test_a_version_that_was_not_finished_does_not_count(spark, tmp_path):
    path = tmp_path / "vault"
    first = codes(mapping.grow_vault(spark, str(path), [words(spark, "a", "b")], SET))
    (path / "version=2").mkdir()
    (path / "version=2" / "part-0.parquet").write_text("cut off")
    assert codes(mapping.read_vault(spark, str(path))) == first
    grown = codes(mapping.grow_vault(spark, str(path), [words(spark, "b", "c")], SET))
    assert set(grown) == {"a", "b", "c"} and grown["c"][1] == 2 and first.items() <= grown.items()


def test_a_grown_vault_is_applied_like_another(spark, tmp_path):
    df, column = words(spark, "a", "b", None)
    vault = mapping.grow_vault(spark, str(tmp_path / "v"), [(df, column)], SET)
    out = {r["v"] for r in mapping.apply_vault(df, column, vault, SET).collect()}
    assert out == {codes(vault)["a"][0], codes(vault)["b"][0], None}
    assert mapping.read_vault(spark, str(tmp_path / "none")).count() == 0


def climb(parents, value, depth):
    path = [value]
    while parents.get(path[-1], path[-1]) != path[-1]:
        path.append(parents[path[-1]])
    return path[::-1][min(depth, len(path) - 1)]


def test_uneven_trees(spark):
    rng = random.Random(2)
    parents = {f"n{i}": f"n{rng.randrange(max(0, i - rng.choice([1, 1, 1, 40])), i)}" for i in range(1, 400)}
    parents["n0"] = "n0"
    parents |= {"x1": "x0"}
    hierarchy = spark.createDataFrame([*parents.items(), ("x0", None)], "value string, parent string").repartition(5)
    values = [*parents, "x0", "unknown", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    for depth in (0, 1, 2, 13, 1000):
        out = {r["id"]: r["v"] for r in mapping.generalize_to_root(df, "v", hierarchy, depth).collect()}
        for i, v in enumerate(values[:-2]):
            assert out[i] == climb(parents, v, depth)
        assert out[len(values) - 2] == "[REDACTED]" and out[len(values) - 1] is None


@pytest.mark.parametrize("links", [[("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y")]])
def test_cycles_and_double_values_are_errors(spark, links):
    df = words(spark, "a")[0]
    with pytest.raises(PolicyError, match="cycle"):
        mapping.generalize_to_root(df, "v", spark.createDataFrame(links, "value string, parent string"))
    with pytest.raises(PolicyError, match="twice"):
        mapping.generalize_to_root(df, "v", spark.createDataFrame([("a", "b"), ("a", "c")], "value string, parent string"))


def test_bijections(spark):
    a = spark.createDataFrame([(1, 10, 5), (2, 20, 5), (3, 30, 6), (4, None, 6)], "id int, k int, other int")
    b = spark.createDataFrame([(1, "10"), (2, "40"), (3, "40")], "id int, k string")
    good = audit.bijections({"a": a, "b": b}, {"a": a.selectExpr("id", "k + 1 AS k", "other"), "b": b.selectExpr("id", "k + 1 AS k")},
                            {"a": ["id"], "b": ["id"]}, [("a.k", "b.k"), ("a.other", "a.other")])
    assert {r["domain"]: tuple(r)[1:] for r in good.collect()} == {
        "a.k": (4, 4, 0, 0, 0, True), "a.other": (2, 2, 0, 0, 0, True)}
    bad = audit.bijections(
        {"a": a, "b": b}, {"a": a.selectExpr("id", "CASE id WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN 7 END AS k"),
                           "b": b.selectExpr("id", "id AS k")}, {"a": ["id"], "b": ["id"]}, [("b.k", "a.k")])
    # 10 and 20 become 1, 40 becomes 2 and 3, 30 is lost, a null has become a key.
    assert tuple(bad.first()) == ("a.k", 3, 3, 1, 1, 2, False)
    with pytest.raises(PolicyError, match="row key"):
        audit.bijections({"a": a}, {"a": a}, {}, [("a.k", "a.k")])
