"""Row methods against plain Python on awkward values."""

import datetime as dt
import hashlib
import math
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veil import PolicyError, anonymize, register_method
from veil.functions.substitution import LISTS

SALT = "s3cr3t-salt"


def sha(text, name="sha256"):
    return hashlib.new(name, (text + SALT).encode()).hexdigest()


def run(spark, settings, values, rule, kind="string", key=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = anonymize(df, {"v": rule}, settings, key or ["i"])
    return [r["v"] for r in out.orderBy("i").collect()]


def rule(method, **options):
    return {"method": method, "options": options}


@pytest.mark.parametrize("name,size", [("sha256", 64), ("sha512", 128), ("md5", 32)])
def test_hash_algorithms(spark, settings, name, size):
    values = ["", "a", "Ünï😀", "x" * 1000, None]
    got = run(spark, settings, values, rule("hash", algorithm=name))
    assert got == [None if v is None else sha(v, name) for v in values]
    assert all(len(g) == size for g in got if g)


@pytest.mark.parametrize("kind,values,texts", [
    ("bigint", [0, -5, 2**62], ["0", "-5", str(2**62)]),
    ("boolean", [True, False], ["True", "False"]),
    ("date", [dt.date(2023, 1, 5)], ["2023-01-05"]),
    ("timestamp", [dt.datetime(2023, 1, 5, 3, 4, 5), dt.datetime(2023, 1, 5, 3, 4, 5, 120)],
     ["2023-01-05 03:04:05", "2023-01-05 03:04:05.000120"]),
    ("timestamp_ntz", [dt.datetime(2023, 1, 5), dt.datetime(2023, 1, 5, 0, 0, 0, 500000)],
     ["2023-01-05 00:00:00", "2023-01-05 00:00:00.500000"]),
    ("decimal(10,2)", [Decimal("1.50")], ["1.50"]),
    ("binary", [bytearray(b"\x01\xff")], ["01ff"]),
])
def test_text_forms(spark, settings, kind, values, texts):
    assert run(spark, settings, values, "hash", kind) == [sha(t) for t in texts]


def test_doubles_read_as_python_writes_them(spark, settings):
    values = [0.0, -0.0, 1.0, 25.5, 0.001, 0.0001, 0.00012345, 1e-5, 1.5e-10, 1e7, 12345678.9, 123456789012345.6,
              1e15, 1e16, 1.5e16, -2.5e300, 1e-300, math.inf, -math.inf, 100.0, -7.25, 9999999.5]
    assert run(spark, settings, values, "hash", "double") == [sha(repr(v)) for v in values]
    assert run(spark, settings, [math.nan], "hash", "double") == [sha("nan")]


def test_mask(spark, settings):
    values = ["", "a", "ab", "abc", "é😀x", "hello world", None]
    assert run(spark, settings, values, "mask") == [None if v is None else "*" * len(v) for v in values]
    edges = run(spark, settings, values, rule("mask", mask_char="#-", preserve_length=False))
    assert edges == ["", "#-", "#-#-", "a#-c", "é#-x", "h" + "#-" * 9 + "d", None]


def test_pseudonymize(spark, settings):
    assert run(spark, settings, ["x", None], rule("pseudonymize", prefix="P")) == ["P_" + sha("x")[:8], None]
    assert run(spark, settings, [7], rule("pseudonymize", length=20), "int") == ["ID_" + sha("7")[:20]]


def bins(v, size):
    low = int(v) // size * size
    return f"{low}-{low + size - 1}"


@pytest.mark.parametrize("size", [1, 5, 10, 100])
def test_bins(spark, settings, size):
    ints = [25, 23, 150, 0, -1, -10, -11, 2**40]
    assert run(spark, settings, ints, rule("generalize_numeric", bin_size=size), "bigint") == [bins(v, size) for v in ints]
    floats = [25.9, -0.5, -5.0, -10.5, 0.0, 1e15]
    assert run(spark, settings, floats, rule("generalize_numeric", bin_size=size), "double") == [bins(v, size) for v in floats]


def test_bins_fail_closed(spark, settings):
    texts = ["12.7", " 8", "abc", "", None, "1e30"]
    assert run(spark, settings, texts, "generalize_numeric") == [
        "10-19", "0-9", "[REDACTED]", "[REDACTED]", None, "[REDACTED]"]
    edge = [-(2**63), 2**63 - 1, None]
    assert run(spark, settings, edge, "generalize_numeric", "bigint") == ["[REDACTED]", "[REDACTED]", None]
    assert run(spark, settings, [math.nan, math.inf], "generalize_numeric", "double") == ["[REDACTED]"] * 2


def python_period(v, granularity):
    for layout in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S"):
        try:
            d = dt.datetime.strptime(v, layout)
        except ValueError:
            continue
        return {"year": str(d.year), "month": f"{d.year}-{d.month:02d}",
                "quarter": f"{d.year}-Q{(d.month + 2) // 3}"}[granularity]
    return None


DATES = ["2023-05-15", "05/06/2023", "25/06/2023", "2023-05-15 10:30:00", "2023-5-1", "2023-02-30", "2024-02-29",
         "2023-02-29", "13/13/2023", "23-05-15", "2023-05-15T10:30:00", "2023-05-15 24:00:00", "2023-05-15 1:2:3",
         "2023-05- 5", "2023-05-15  10:30:00", " 2023-05-15", "2023-05-15 ", "0000-01-01", "0999-01-01", "", "2023-05",
         "2023", "31/12/1999", "12/31/1999", "1/2/0001", "2023-00-10", "2023-10-00", "2023/05/15", "15.05.2023",
         "2023-05-15 10:60:00", "02/30/2023", "2023-005-15", "1/ 2/2023", "2023-05-15\n"]


@pytest.mark.parametrize("granularity", ["year", "month", "quarter"])
def test_date_texts(spark, settings, parity, granularity):
    r = rule("generalize_date", granularity=granularity)
    want = [python_period(v, granularity) for v in DATES]
    assert run(spark, settings, DATES + [None], r) == [w or "[REDACTED]" for w in want] + [None]
    assert run(spark, parity, DATES + [None], r) == [w or v for w, v in zip(want, DATES)] + ["nan"]


def test_date_types(spark, settings):
    assert run(spark, settings, [dt.date(2023, 12, 31), None], rule("generalize_date", granularity="quarter"), "date") == [
        "2023-Q4", None]
    stamps = [dt.datetime(2023, 7, 1, 23, 59)]
    assert run(spark, settings, stamps, "generalize_date", "timestamp") == ["2023-07"]
    assert run(spark, settings, stamps, "generalize_date", "timestamp_ntz") == ["2023-07"]


def python_email(v, lenient):
    if "@" not in v:
        return v if lenient else "[REDACTED]"
    local, domain = v.split("@", 1)
    if domain not in ("gmail.com", "yahoo.com", "outlook.com"):
        company = "company" + sha(domain)[:6]
        if "." in domain:
            domain = company + "." + domain.split(".")[-1]
        elif not lenient:
            domain = company
    return f"user{sha(local)[:8]}@{domain}"


MAILS = ["john@company.com", "a@b@c.co.uk", "test@", "@", "x@foo.", "x@localhost", "User@GMAIL.com", "u@gmail.com",
         "not_an_email", "", "é@ü.de", "@x.org"]


def test_email(spark, settings, parity):
    assert run(spark, settings, MAILS, "anonymize_email") == [python_email(v, False) for v in MAILS]
    assert run(spark, parity, MAILS, "anonymize_email") == [python_email(v, True) for v in MAILS]


def python_phone(v, lenient):
    digits = re.sub("[^0-9]", "", v)
    if len(digits) < 7:
        return v if lenient else "[REDACTED]"
    h, out, k = sha(v), [], 0
    h += "".join(hashlib.sha256(f"{sha(v)}|{n}".encode()).hexdigest() for n in range(1, len(digits) // 32 + 1))
    for ch in v:
        if ch in "0123456789":
            ch = str(int(h[2 * k:2 * k + 2], 16) % 10)
            k += 1
        out.append(ch)
    return "".join(out)


PHONES = ["(555) 123-4567", "555-987-6543", "555.555.5555", "5551234567", "555-1234", "", "abc", "123", "123456",
          "1234567", "+44 20 7946 0958 ext. 12", "1" * 15, "2" * 16, "3" * 32, "4" * 33, "5" * 64 + "x" + "6" * 40, "a1b2c3d4e5f6g7", "1234567\n"]


def test_phone(spark, settings, parity):
    assert run(spark, settings, PHONES, "anonymize_phone") == [python_phone(v, False) for v in PHONES]
    assert run(spark, parity, PHONES, "anonymize_phone") == [python_phone(v, True) for v in PHONES]
    assert run(spark, settings, [5551234567, None], "anonymize_phone", "bigint") == [python_phone("5551234567", False), None]


def test_phone_normalized_formats_agree(spark, settings):
    got = run(spark, settings, ["555-123-4567", "(555) 123 4567"], rule("anonymize_phone", normalize=True))
    assert re.sub("[^0-9]", "", got[0]) == re.sub("[^0-9]", "", got[1])


def python_ssn(v):
    digits = "".join(str(ord(ch) % 10) for ch in sha(v))
    dashed = f"{digits[:3]}-{digits[3:5]}-{digits[5:9]}"
    if re.match("[0-9]{3}-[0-9]{2}-[0-9]{4}", v):
        return dashed
    return digits[:9] if re.match("[0-9]{9}", v) else dashed


def test_ssn(spark, settings):
    values = ["123-45-6789", "123456789", "123-45-6789x", "1234567890", "junk", "", "12-345-6789"]
    assert run(spark, settings, values, "anonymize_ssn") == [python_ssn(v) for v in values]
    assert run(spark, settings, [123456789, 42, None], "anonymize_ssn", "int") == [
        python_ssn("123456789"), python_ssn("000000042"), None]


def python_u(column, i, nth=0):
    h = hashlib.sha256(f"dr4w-key|{column}|{i}".encode()).hexdigest()
    return (int(h[13 * nth:13 * nth + 13], 16) + 0.5) / 2**52


def test_laplace_and_gaussian(spark, settings):
    got = run(spark, settings, [0.0] * 200, rule("differential_privacy", epsilon=0.5), "double")
    for i, g in enumerate(got):
        u = python_u("v", i)
        want = 2 * math.log(2 * u) if u < 0.5 else -2 * math.log(2 * (1 - u))
        assert g == pytest.approx(want, rel=1e-9, abs=1e-9)
    got = run(spark, settings, [10] * 200, rule("differential_privacy", mechanism="gaussian"), "int")
    for i, g in enumerate(got):
        noise = math.sqrt(-2 * math.log(python_u("v", i))) * math.cos(2 * math.pi * python_u("v", i, 1))
        assert g == int(10 + noise)


def test_noise_moments(spark, settings):
    n = 20000
    flat = run(spark, settings, [0.0] * n, "differential_privacy", "double")
    mean, var = sum(flat) / n, sum(x * x for x in flat) / n
    assert abs(mean) < 0.05 and 1.85 < var < 2.15
    normal = run(spark, settings, [0.0] * n, rule("perturb", type="gaussian", range=3), "double")
    mean, var = sum(normal) / n, sum(x * x for x in normal) / n
    assert abs(mean) < 0.1 and 8.5 < var < 9.5


def test_perturb(spark, settings):
    got = run(spark, settings, [50000] * 300, rule("perturb", type="uniform", range=5000), "int")
    assert all(45000 <= v <= 55000 for v in got) and len(set(got)) > 250
    got = run(spark, settings, [50000.0] * 300, rule("perturb", type="percentage", percentage=10), "double")
    assert all(45000 <= v <= 55000 for v in got)
    got = run(spark, settings, [-100.0] * 300, "perturb", "double")
    assert all(-110 <= v <= -90 for v in got)
    got = run(spark, settings, [1] * 300, rule("perturb", range=50, non_negative=True), "int")
    assert all(0 <= v <= 51 for v in got)
    assert run(spark, settings, [None], "perturb", "double") == [None]
    odd = run(spark, settings, [10.0] * 50, rule("perturb", type="other", range=1), "double")
    assert all(9 <= v <= 11 for v in odd)


def test_noise_keeps_the_type_and_overflow_is_null(spark, settings):
    df = spark.createDataFrame([(1, 127, 2**63 - 1, Decimal("5.25"))], "i int, b tinyint, l bigint, d decimal(5,2)")
    big = rule("perturb", range=10**20)
    out = anonymize(df, {"b": big, "l": big, "d": rule("perturb", range=1)}, settings, ["i"])
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "tinyint", "bigint", "decimal(5,2)"]
    row = out.first()
    assert row["b"] is None and row["l"] is None and abs(row["d"] - Decimal("5.25")) <= 1


def test_noise_needs_numbers(spark, settings, parity):
    for kind, value in (("string", "5"), ("boolean", True)):
        for method in ("differential_privacy", "perturb"):
            with pytest.raises(PolicyError):
                run(spark, settings, [value], method, kind)
            assert run(spark, parity, [value], method, kind) == [value]


def test_substitute(spark, settings):
    assert run(spark, settings, ["CEO", None], rule("substitute", type="generic")) == ["[REDACTED]"] * 2
    names = run(spark, settings, ["x"] * 300 + [None], rule("substitute", type="names"))
    assert set(names) == set(LISTS["names"])
    assert run(spark, settings, ["x"], rule("substitute", list=[], type="nothing")) == ["[REDACTED]"]
    own = run(spark, settings, ["a", "b", "a", "b"] * 10, rule("substitute", list=["p", "q", "r"], consistent=True))
    assert own == own[:2] * 20


def test_nulls_literal(spark, settings, parity):
    assert run(spark, settings, [None], rule("hash", nulls="literal")) == [sha("nan")]
    assert run(spark, parity, [None], "hash") == [sha("nan")]
    assert run(spark, parity, [None], "mask") == ["***"]
    assert run(spark, parity, [None], rule("hash", nulls="keep")) == [None]


def test_registered_method(spark, settings):
    register_method("initial", lambda b, name, c, dtype, o: c.substr(1, o["n"]), {"n": 1})
    assert run(spark, settings, ["abc"], rule("initial", n=2)) == ["ab"]
    with pytest.raises(PolicyError):
        register_method("hash", lambda *a: None)


@pytest.mark.parametrize("kind", ["array<int>", "map<string,int>", "struct<a:int>"])
def test_nested_columns_are_refused(spark, settings, kind):
    df = spark.createDataFrame([], f"v {kind}")
    with pytest.raises(PolicyError):
        anonymize(df, {"v": "hash"}, settings)


def test_noise_reaches_the_last_digits_of_large_numbers(spark, settings):
    df = spark.range(200).select("id", (F.col("id") + 2**60).alias("n"),
                                 (F.col("id") + F.lit("12345678901234567890.12").cast("decimal(30,2)"))
                                 .cast("decimal(30,2)").alias("d"))
    for method in ("differential_privacy", rule("perturb", range=50)):
        out = anonymize(df, {"n": method, "d": method}, settings, ["id"]).orderBy("id").collect()
        assert len({r["n"] - r["id"] for r in out}) > 3 and all(abs(r["n"] - r["id"] - 2**60) < 100 for r in out)
        assert len({r["d"] - r["id"] for r in out}) > 100
