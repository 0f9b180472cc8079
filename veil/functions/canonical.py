"""The text form of a value, which every digest is taken over."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from veil.errors import PolicyError

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def ident(name: str) -> Column:
    """The column called exactly ``name``, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _floating(c: Column) -> Column:
    """Decimal notation from 1e-4 up to 1e16, exponent notation outside."""
    text = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    exponent = F.regexp_replace(text, r"\.0E", "E")
    exponent = F.regexp_replace(exponent, r"E(\d)", "e+$1")
    exponent = F.regexp_replace(exponent, r"E-(\d)$", "e-0$1")
    exponent = F.regexp_replace(exponent, "E-", "e-")
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def _timestamp(c: Column) -> Column:
    """Seconds, and six digits of a fraction if there is one."""
    text = c.cast("string")
    return F.when(F.instr(text, ".") > 0, F.rpad(text, 26, "0")).otherwise(text)


def canon(c: Column, dtype: T.DataType, scale: int | None = None) -> Column:
    """``c`` as text; null stays null.  ``scale`` fixes the digits of a fraction."""
    if isinstance(dtype, NESTED):
        raise PolicyError(f"no text form is defined for {dtype.simpleString()}")
    if scale is not None and isinstance(dtype, (T.FractionalType,)):
        return c.try_cast(T.DecimalType(38, scale)).cast("string")
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return _timestamp(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _floating(c)
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(c))
    return c.cast("string")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))
