"""k-anonymity: values or combinations of values that occur less than k times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veil.errors import PolicyError
from veil.functions.build import SUPPRESSED
from veil.functions.canonical import canon, ident, is_text
from veil.operators.lookup import BROADCAST_BYTES, _COUNT, attach, row_bytes
from veil.operators.materialize import materialize

_SCOPE = "__veil_scope"
_LONG = 72  # longer texts are compared by their 71-byte stand-in


def _compact(df: DataFrame, column: str) -> Column:
    """A short key that is equal exactly where the values are equal."""
    c = ident(column)
    if not is_text(df.schema[column].dataType):
        return c
    stand_in = F.concat(F.lit("sha256:"), F.sha2(c, 256))
    return F.when(F.octet_length(c) >= _LONG, stand_in).otherwise(c)


def flag_frequent(
    df: DataFrame,
    columns: list[str],
    k: int,
    flag: str,
    source: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    scope: Column | None = None,
) -> DataFrame:
    """Add ``flag``: whether the row's values occur at least ``k`` times.

    With a ``scope`` only the rows in it count, and the flag means nothing for
    the others; they are still part of what is measured to find hot values.

    Counting is one aggregate over the named columns, combined before its
    shuffle.  The way back is a broadcast of the frequent or of the rare
    combinations, whichever is small; only if neither is, rows are shuffled.
    ``source`` may be an unjoined form of ``df`` to count on.
    """
    keys = [f"__veil_k{i}" for i in range(len(columns))]
    source = df if source is None else source
    inside = F.lit(True) if scope is None else scope
    narrow = source.select(*[_compact(source, c).alias(k) for c, k in zip(columns, keys)], inside.alias(_SCOPE))
    counts = materialize(narrow.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(_COUNT), F.count_if(ident(_SCOPE)).alias(_SCOPE)))
    size = row_bytes(counts, keys)
    frequent, rare = F.col(_SCOPE) >= k, F.col(_SCOPE).between(1, k - 1)
    sizes = counts.agg(
        F.coalesce(F.sum(F.when(frequent, size)), F.lit(0)).alias("frequent"),
        F.coalesce(F.sum(F.when(rare, size)), F.lit(0)).alias("rare"),
    ).first()
    use_rare = sizes["rare"] < sizes["frequent"]
    table = counts.filter(rare if use_rare else frequent).select(
        *keys, F.lit(not use_rare).alias(flag)
    )
    counts = counts.drop(_SCOPE)
    keyed = df.withColumns({k: _compact(df, c) for c, k in zip(columns, keys)})
    size = min(sizes["rare"], sizes["frequent"])
    out = attach(keyed, keys, table, counts, size, broadcast_bytes).drop(*keys)
    return out.withColumn(flag, F.coalesce(ident(flag), F.lit(use_rare)))


def suppressed(c: Column, dtype, flag: str, scale: int | None = None) -> Column:
    """The column's text where the flag holds; nulls stay null."""
    text = canon(c, dtype, scale)
    return F.when(c.isNull(), F.lit(None)).when(ident(flag), text).otherwise(F.lit(SUPPRESSED))


def k_anonymity(
    df: DataFrame,
    quasi_ids: list[str],
    k: int = 5,
    drop: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows whose combination of quasi-identifiers is shared by at least ``k`` rows.

    Smaller classes are dropped, or their quasi-identifiers suppressed.
    """
    missing = [c for c in quasi_ids if c not in df.columns]
    if missing or not quasi_ids:
        raise PolicyError(f"no such columns: {missing}" if missing else "name the quasi-identifiers")
    if k < 1:
        raise PolicyError("k must be at least 1")
    flag = "__veil_keep"
    out = flag_frequent(df, quasi_ids, k, flag, broadcast_bytes=broadcast_bytes)
    if drop:
        return out.filter(ident(flag)).select(*[ident(c) for c in df.columns])
    return out.select(*[
        suppressed(ident(c), df.schema[c].dataType, flag).alias(c) if c in quasi_ids else ident(c)
        for c in df.columns
    ])
