"""Generalization of dates to a coarser period."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from veil.errors import PolicyError
from veil.functions.build import REDACTED, Build
from veil.functions.canonical import canon, is_text

GRANULARITIES = ("year", "quarter", "month")

# The layouts a date may have, in this order: year-month-day, month/day/year,
# day/month/year, and the first with a time of day.  A day may be padded by a blank.
_YEAR, _MONTH, _DAY = "([0-9]{4})", "([0-9]{1,2})", "( [1-9]|[0-9]{1,2})"
_TIME = r"(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]"
_DASHED = rf"^{_YEAR}-{_MONTH}-{_DAY}(?:\s+{_TIME})?\z"
_MONTH_FIRST = rf"^{_MONTH}/{_DAY}/{_YEAR}\z"
_DAY_FIRST = rf"^{_DAY}/{_MONTH}/{_YEAR}\z"


def _slashed(text: Column, layout: str, order: str) -> Column:
    """Text in another layout keeps its slashes, which no date has."""
    return F.replace(F.regexp_replace(text, layout, order), F.lit(" "), F.lit("")).try_cast("date")


def _read(text: Column) -> Column:
    """The date in a text.  No bad value costs an exception, as a date parser's would."""
    slashed = F.coalesce(_slashed(text, _MONTH_FIRST, "$3-$1-$2"), _slashed(text, _DAY_FIRST, "$3-$2-$1"))
    dashed = F.when(text.rlike(_DASHED), F.replace(text, F.lit("- "), F.lit("-")).try_cast("date"))
    return F.when(text.contains("/"), slashed).otherwise(dashed)


def period(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    if is_text(dtype):
        day, other = b.bind(_read(c)), b.text(c, dtype, options)
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        day, other = c, canon(c, dtype)
    elif b.lenient(options):
        return canon(c, dtype)
    else:
        raise PolicyError(f"{name}: no date can be read from {dtype.simpleString()}")
    year = F.when(F.year(day) >= 1, F.year(day).cast("string"))
    if options["granularity"] == "year":
        label = year
    elif options["granularity"] == "quarter":
        label = F.concat(year, F.lit("-Q"), F.quarter(day).cast("string"))
    else:
        label = F.concat(year, F.lit("-"), F.lpad(F.month(day).cast("string"), 2, "0"))
    unread = other if b.lenient(options) else F.when(c.isNotNull(), F.lit(REDACTED))
    return F.coalesce(label, unread)
