"""Value types, their lattice and checksums; the one-pass report on tables with nothing in them."""

import math
from collections import Counter

import pytest

from veil import PolicyError
from veil.operators import audit
from veil.operators.value_types import detect_types


def typed(spark, *values, enough=0.95):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    r = detect_types(df, enough=enough).first()
    return r["type"], r["role"]


@pytest.mark.parametrize("values, kind", [
    (["1", "-2", " +3 "], "integer"), (["1", "2.5", "1e-3", ".5", "7."], "decimal"), (["1", "x"], "text"),
    (["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009"], "card"),
    (["4111111111111112", "5500000000000005"], "integer"),
    (["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "fr1420041010050500013m02606"], "iban"),
    (["DE88 3704 0044 0532 0130 00"], "text"), (["123-45-6789"], "ssn"), (["000-45-6789", "666-45-6789"], "phone"),
    (["a.b+c@x-y.co.uk", "A@B.DE"], "email"), (["test@", "a@b"], "text"), (["192.168.0.1", "10.0.0.255"], "ip"),
    (["192.168.0.256"], "text"), (["123e4567-e89b-12d3-a456-426614174000"], "uuid"), (["yes", "No", "T"], "boolean"),
    (["2023-01-31", "2023-1-5 10:00:00"], "date_dashed"), (["2023-02-30"], "text"), (["12/31/2023", "1/2/2023"], "date_month_first"),
    (["31/12/2023", "1/2/2023"], "date_day_first"), (["2023-01-31", "12/31/2023", "31/12/2023"], "date"),
    (["(555) 123-4567", "+44 20 7946 0958", "555.123.4567 x12"], "phone"), (["", " "], "text"), ([None, None], "text"),
])
def test_types(spark, values, kind):
    assert typed(spark, *values)[0] == kind


def test_a_few_odd_values_do_not_matter(spark):
    values = [str(i) for i in range(97)] + ["?", "n/a", None]
    assert typed(spark, *values)[0] == "integer"
    assert typed(spark, *values, enough=1.0)[0] == "text"


def test_roles(spark):
    df = spark.createDataFrame(
        [(i, i % 3, i / 7, ["red", "blue"][i % 2], f"she said that it was {i % 90} times too late", f"K{i % 60}", None)
         for i in range(200)], "id int, few int, x double, colour string, said string, code string, none string")
    out = {r["column"]: r for r in detect_types(df).collect()}
    assert {c: r["role"] for c, r in out.items()} == {
        "id": "identifier", "few": "category", "x": "measure", "colour": "category", "said": "prose",
        "code": "attribute", "none": "attribute"}
    assert {c: r["method"] for c, r in out.items()} == {
        "id": "pseudonymize", "few": "generalize_numeric", "x": "generalize_numeric", "colour": "k_anonymity",
        "said": "remove", "code": "none", "none": "none"}
    assert out["none"]["nulls"] == 200 and out["none"]["share"] == 0.0
    assert detect_types(df.limit(0)).count() == 7
    with pytest.raises(PolicyError):
        detect_types(df, ["nothing"])


def test_report_against_plain_figures(spark):
    rows = [(["a", "b", None][i % 3], i % 4, None if i % 11 == 0 else f"s{i % (2 + i % 3)}", 1e9 + i, 1e9 + 2 * i)
            for i in range(240)] + [("alone", None, "s0", 5.0, None)]
    df = spark.createDataFrame(rows, "`q 1` string, q2 int, s string, old double, new double")
    got = {(r["section"], r["item"]): r["value"] for r in audit.full_report(
        df, ["q 1", "q2"], "s", {"old": "new"}).collect()}
    classes = Counter(r[:2] for r in rows)
    cells, overall = Counter(r[:3] for r in rows), Counter(r[2] for r in rows)
    assert got["classes", "count"] == len(classes) and got["classes", "rows"] == 241
    assert got["risk", "unique_rows"] == 1 and got["risk", "max"] == 1 and got["classes", "max"] == max(classes.values())
    assert got["diversity", "min_distinct"] == min(
        len({c[2] for c in cells if c[:2] == k and c[2] is not None}) for k in classes)
    assert got["diversity", "max_share"] == max(n / classes[c[:2]] for c, n in cells.items())
    assert got["closeness", "max"] == pytest.approx(max(
        sum(abs(cells[(*k, v)] / n - m / 241) for v, m in overall.items()) / 2 for k, n in classes.items()))
    assert {k[1]: v for k, v in got.items() if k[0] == "histogram"} == {
        str(size): n for size, n in Counter(classes.values()).items()}
    for item, columns in (("q 1", [0]), ("q2", [1]), ("q 1,q2", [0, 1])):
        sizes = Counter(tuple(r[c] for c in columns) for r in rows)
        assert got["subset", item] == min(sizes.values()) and got["subset_classes", item] == len(sizes)
        assert got["unique", item] == sum(n == 1 for n in sizes.values())

    def moments(values):
        mean = math.fsum(values) / len(values)
        return mean, math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (len(values) - 1))

    (mean, std), (new_mean, new_std) = moments([r[3] for r in rows]), moments([r[4] for r in rows if r[4] is not None])
    assert got["mean_shift", "old"] == pytest.approx(abs(new_mean - mean) / mean)
    assert got["std_shift", "old"] == pytest.approx(abs(new_std - std) / std)


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "q string, s string, x double")
    got = {(r["section"], r["item"]): r["value"] for r in audit.full_report(empty, ["q"], "s", {"x": "x"}).collect()}
    assert got["classes", "count"] == 0 and got["classes", "rows"] == 0 and got["risk", "max"] is None
    with pytest.raises(PolicyError):
        audit.full_report(empty, [])
