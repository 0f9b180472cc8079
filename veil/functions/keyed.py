"""Salted digests and keyed random draws as plain column expressions.

The salt and the key reach the plan as scalar subqueries over a one-row table,
never as literals: neither ``explain`` nor the event log shows them.

A draw is a digest of the key, a tag and the row key.  It does not depend on the
partitioning, so a task that runs twice draws the same numbers, and without
the key the numbers cannot be foretold.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veil.errors import PolicyError
from veil.functions.canonical import canon, ident
from veil.settings import Settings

ALGORITHMS = ("sha256", "sha512", "md5")
_HEX = 13  # 52 bits, which a double holds exactly


def local_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A small table from values on the driver, without a Python worker behind it."""
    return spark.createDataFrame(pa.table(columns))


class Secrets:
    """The salt and the key of a job as columns of the running plan."""

    def __init__(self, spark: SparkSession, settings: Settings):
        row = local_table(spark, salt=[settings.salt], key=[settings.key])
        self.salt: Column = row.select("salt").scalar()
        self.key: Column = row.select("key").scalar()

    def digest(self, text: Column, algorithm: str = "sha256") -> Column:
        """Lower-case hex digest of the text followed by the salt."""
        salted = F.concat(text, self.salt)
        if algorithm == "sha256":
            return F.sha2(salted, 256)
        if algorithm == "sha512":
            return F.sha2(salted, 512)
        if algorithm == "md5":
            return F.md5(salted)
        raise PolicyError(f"unsupported hash algorithm: {algorithm}")

    def draw(self, tag: str, row_key: list[Column]) -> Column:
        """Hex digest that is the source of the draws of one row and tag."""
        parts = [F.coalesce(k, F.lit("")) for k in row_key]
        return F.sha2(F.concat_ws("|", self.key, F.lit(tag), *parts), 256)


def key_text(df: DataFrame, names: list[str]) -> list[Column]:
    """The row key columns in text form."""
    return [canon(ident(n), df.schema[n].dataType) for n in names]


def uniform(draw: Column, nth: int = 0) -> Column:
    """The ``nth`` uniform number in the open interval (0, 1) of a draw."""
    bits = F.conv(F.substring(draw, 1 + _HEX * nth, _HEX), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(2.0 ** (4 * _HEX))


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise by inversion; every step before the logarithm is exact."""
    centred = u - F.lit(0.5)
    return F.lit(-float(scale)) * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def gaussian(u1: Column, u2: Column, scale: Column) -> Column:
    """Normal noise by the Box-Muller transform."""
    return scale * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def pick(u: Column, choices: list) -> Column:
    """One of the literal choices, each equally likely."""
    index = F.floor(u * F.lit(float(len(choices)))).cast("int") + F.lit(1)
    return F.element_at(F.array(*[F.lit(x) for x in choices]), index)


def between(u: Column, low: int, high: int) -> Column:
    """A whole number from ``low`` up to, but without, ``high``."""
    return (F.floor(u * F.lit(float(high - low))) + F.lit(low)).cast("int")
