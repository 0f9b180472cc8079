"""Left join with a table of unique keys, safe for large tables and hot keys.

The lookup side is measured first.  If it is small it is broadcast and the main
table is not shuffled at all.  If it is not, keys that hold more than one
thousandth of the rows are looked up by a broadcast of those keys alone - there
are at most a thousand of them - and only the remaining rows are shuffled, none
of whose keys can dominate a task.  If even those few keys are too long to be
broadcast, each of them is copied to several tasks and its rows are dealt to those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veil.functions.canonical import ident
from veil.operators.materialize import materialize

BROADCAST_BYTES = 32 << 20
HOT_KEYS = 1000
#: Tasks that a hot key goes to if it cannot be broadcast.
COPIES = 64
_ROW_BYTES = 32  # what a stored row costs besides its values
_COUNT = "__veil_n"
_HOT = "__veil_hot"
_SALT = "__veil_copy"


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Upper estimate of a row's size, for sums over a whole table."""
    sizes = [
        F.coalesce(F.octet_length(ident(c).cast("string")), F.lit(0)) + F.lit(16)
        for c in (columns or df.columns)
    ]
    total = F.lit(_ROW_BYTES)
    for s in sizes:
        total = total + s
    return total.cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; null is a key like any other."""
    return df.groupBy(*[ident(k) for k in keys]).agg(F.count(F.lit(1)).alias(_COUNT))


def _join(df: DataFrame, table: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Null-safe left join that keeps the key columns of ``df`` only."""
    renamed = {k: f"__veil_key_{i}" for i, k in enumerate(keys)}
    right = table.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for k, other in renamed.items():
        condition = condition & ident(k).eqNullSafe(ident(other))
    right = F.broadcast(right) if small else right
    return df.join(right, condition, "left").drop(*renamed.values())


def attach(
    df: DataFrame,
    keys: list[str],
    table: DataFrame,
    counts: DataFrame | None = None,
    table_bytes: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` plus the other columns of ``table``, null where no key matches.

    ``table`` has one row per key.  ``counts`` are the rows per key of ``df``
    and ``table_bytes`` the size of ``table``, if the caller knows them already.
    """
    if (measured_bytes(table) if table_bytes is None else table_bytes) <= broadcast_bytes:
        return _join(df, table, keys, small=True)
    counts = key_counts(df, keys) if counts is None else counts
    total = counts.agg(F.sum(_COUNT).alias("n")).first()["n"] or 0
    hot = counts.filter(F.col(_COUNT) * HOT_KEYS > F.lit(total)).drop(_COUNT)
    hot = materialize(_join(hot, table, keys, small=False).withColumn(_HOT, F.lit(True)))
    if hot.count() == 0:
        return _join(df, table, keys, small=False)
    marker = F.coalesce(ident(_HOT), F.lit(False))
    if measured_bytes(hot) > broadcast_bytes:
        # A deal by all columns of the row is the same in every run of a task.
        plain = [ident(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        dealt = df.withColumn(_SALT, F.pmod(F.xxhash64(*plain), F.lit(COPIES)).cast("int"))
        copies = hot.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        known = _join(dealt, copies, [*keys, _SALT], small=False).drop(_SALT)
        others = [c for c in table.columns if c not in keys]
        rest = known.filter(~marker).drop(_HOT, *others)
        return known.filter(marker).drop(_HOT).unionByName(_join(rest, table, keys, small=False))
    done = _join(df, hot, keys, small=True).filter(marker).drop(_HOT)
    rest = _join(_join(df, hot.select(*keys, _HOT), keys, small=True).filter(~marker).drop(_HOT),
                 table, keys, small=False)
    return done.unionByName(rest)
