"""What kind of values columns hold, whatever type they are stored in.

Value types form a lattice: a value of a specific type is also one of the more
general types above it, up to text.  All tests of all columns are counted in one
aggregate, so the counts of chunks could be added up; a column's type is the
most specific one that nearly all of its values have, which for mixed values is
the least type above them all: integers and decimals are decimals, dates in two
layouts are dates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veil.errors import PolicyError
from veil.functions import dates
from veil.functions.canonical import canon, ident
from veil.functions.keyed import local_table

#: Share of the values that have to be of a type.
ENOUGH = 0.95
#: Distinct values are counted exactly up to 2 to this power, beyond it with a relative error of 0.8 percent.
DISTINCT_BITS = 14
#: A key has nearly as many distinct values as values; a category has few, or few for its size.
KEY_SHARE, CATEGORY_VALUES, CATEGORY_SHARE = 0.95, 20, 0.01
#: Words of a text on average from which it is prose.
PROSE_WORDS = 4


def _luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[- ]", "")
    return text.rlike(r"^[0-9](?:[- ]?[0-9]){12,18}\z") & F.call_function("luhn_check", digits)


def _iban(text: Column) -> Column:
    """Letters count as 10 to 35; the country and check digits go to the end; the rest by 97 is one."""
    plain = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def fold(rest: Column, c: Column) -> Column:
        value = F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(c >= "A", 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), fold)
    return F.when(plain.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z"), rest == 1).otherwise(F.lit(False))


def _date(layout: str, order: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(layout) & dates._slashed(text, layout, order).isNotNull()


def _pattern(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


# A country code, groups of two to five digits, a last group of three to eight, an extension.
_PHONE = (r"^(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ .-])(?:[0-9]{2,5}[ .-])*[0-9]{3,8}"
          r"(?: ?(?:x|ext\.?) ?[0-9]{1,5})?\z")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class ValueType:
    """A type, the more general type above it, and the method for columns of it."""

    name: str
    above: str
    test: Callable[[Column], Column]
    method: str


#: The more specific types come first.
TYPES = [
    ValueType("card", "text", _luhn, "hash"),
    ValueType("ssn", "text", _pattern(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\z"), "anonymize_ssn"),
    ValueType("iban", "text", _iban, "hash"),
    ValueType("uuid", "text", _pattern(r"^(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\z"), "hash"),
    ValueType("ip", "text", _pattern(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"), "hash"),
    ValueType("email", "text", _pattern(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"), "anonymize_email"),
    ValueType("date_dashed", "date", lambda text: text.rlike(dates._DASHED) & dates._read(text).isNotNull(), "generalize_date"),
    ValueType("date_month_first", "date", _date(dates._MONTH_FIRST, "$3-$1-$2"), "generalize_date"),
    ValueType("date_day_first", "date", _date(dates._DAY_FIRST, "$3-$2-$1"), "generalize_date"),
    ValueType("date", "text", lambda text: dates._read(text).isNotNull(), "generalize_date"),
    ValueType("boolean", "text", _pattern(r"^(?i)(?:true|false|yes|no|[tfyn])\z"), "none"),
    ValueType("integer", "decimal", _pattern(r"^[+-]?[0-9]{1,38}\z"), "generalize_numeric"),
    ValueType("decimal", "text", _pattern(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), "generalize_numeric"),
    ValueType("phone", "text", _pattern(_PHONE), "anonymize_phone"),
    ValueType("text", "", lambda text: F.lit(True), "none"),
]
_SCHEMA = ("column string, values bigint, nulls bigint, type string, share double, role string, distinct bigint, "
           "method string")


def detect_types(df: DataFrame, columns: list[str] | None = None, enough: float = ENOUGH) -> DataFrame:
    """Per column its value type, the share of values that have it, its role and a method for it.

    Roles: ``identifier`` (nearly all values differ), ``category`` (few distinct
    values), ``measure`` (other numbers), ``prose`` (texts of several words) and
    ``attribute``.  Blanks around values do not count.  A column without values is
    of type text, with a share of zero.
    """
    names = columns or df.columns
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise PolicyError(f"no such columns: {missing}")
    if not names:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    # One row for each value, so that every test is compiled once, whatever the number of columns.
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.trim(canon(ident(c), df.schema[c].dataType)).alias("text")) for c in names])))
    text = F.col("text")
    counted = values.groupBy("column").agg(
        F.count(text).alias("values"), F.count_if(text.isNull()).alias("nulls"),
        F.array(*[F.count_if(t.test(text) & text.isNotNull()) for t in TYPES]).alias("hits"),
        F.avg(F.size(F.split(text, r"\s+"))).alias("words"),
        F.theta_sketch_estimate(F.theta_sketch_agg(text, DISTINCT_BITS)).alias("distinct"))
    asked = local_table(df.sparkSession, column=pa.array(names, pa.string()))
    found = asked.join(counted, "column", "left").fillna(0, ["values", "nulls", "distinct"]).withColumn(
        "hits", F.coalesce("hits", F.array(*[F.lit(0)] * len(TYPES)).cast("array<bigint>")))
    types = F.array(*[F.struct(F.lit(t.name).alias("type"), F.lit(t.method).alias("method")) for t in TYPES])
    hits = F.transform(F.arrays_zip(types.alias("t"), F.col("hits").alias("n")), lambda z: F.struct(
        z["t"]["type"].alias("type"), z["t"]["method"].alias("method"),
        F.coalesce(F.try_divide(z["n"], F.col("values")), F.lit(0.0)).alias("share")))
    # Text holds for all values, so there is always a type.
    chosen = F.coalesce(F.get(F.filter(hits, lambda h: h["share"] >= enough), F.lit(0)), F.element_at(hits, -1))
    typed = found.withColumn("t", chosen)
    number = F.col("t.type").isin("integer", "decimal")
    few = F.col("distinct") <= F.greatest(F.lit(CATEGORY_VALUES), F.col("values") * CATEGORY_SHARE)
    role = F.when(F.col("values") == 0, "attribute").when(
        (F.col("distinct") >= F.col("values") * KEY_SHARE) & (F.col("t.type") != "decimal"), "identifier").when(
        few, "category").when(number, "measure").when(
        (F.col("t.type") == "text") & (F.col("words") >= PROSE_WORDS), "prose").otherwise("attribute")
    out = typed.withColumn("role", role)
    plain = F.col("t.type").isin("text", "integer")
    method = F.when(plain & (F.col("role") == "identifier"), "pseudonymize").when(
        (F.col("t.type") == "text") & (F.col("role") == "category"), "k_anonymity").when(
        F.col("role") == "prose", "remove").otherwise(F.col("t.method"))
    return out.select("column", "values", "nulls", F.col("t.type").alias("type"), F.col("t.share").alias("share"), "role",
                      "distinct", method.alias("method"))
