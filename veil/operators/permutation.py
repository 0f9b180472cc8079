"""A uniform random permutation of a column over the whole table.

Every row has a rank by its row key and every value a rank by a keyed digest;
both are dense, and joining them deals the values out again.  Ranks come from
sorted partitions plus one offset per partition, so no task ever sees the whole
column.  Row keys are range-partitioned; digests are uniform, so their ranges
are known beforehand and no sampling pass has to compute them once more.

A task's rows stay as few when the table grows: larger tables get more
partitions than the session's usual number.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.errors import PolicyError
from veil.functions.canonical import ident
from veil.functions.keyed import Secrets, key_text, local_table
from veil.operators.materialize import materialize

ROW_ID = "__veil_row_id"
_RANK = "__veil_rank"
_PLACE = "__veil_place"
_PART = "__veil_part"
_DRAW = "__veil_draw"
_START = "__veil_start"
_TIMES = "__veil_times"
_PART_HEX = 8  # hex digits that choose the partition
_PART_BITS = 33  # monotonically_increasing_id: partition above, row number below
_PILE = "__veil_pile"
_DEALT_PILE = "__veil_dealt_pile"
_TASK_ROWS = 1 << 19  # rows that one task sorts


def with_row_id(df: DataFrame) -> DataFrame:
    """Number the rows; stored, so that every later plan sees the same numbers."""
    return materialize(df.withColumn(ROW_ID, F.monotonically_increasing_id()))


def _usual(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _parts(df: DataFrame) -> int | None:
    """The number of partitions for the rows of ``df``; None if it may be the usual one.

    Spark may join those until only every core has one, so they do no longer than that.
    """
    needed, usual = -(-df.count() // _TASK_ROWS), _usual(df.sparkSession)
    return max(needed, usual) if needed > min(usual, df.sparkSession.sparkContext.defaultParallelism) else None


def _dense(placed: DataFrame, checked: list[str] | None = None) -> tuple[DataFrame, int]:
    """Turn stored places within partitions into ranks from 0; also the row count.

    ``checked`` are row keys, each stored once with its number of rows.
    """
    part = F.shiftright(_PLACE, _PART_BITS).alias(_PART)
    has_null = F.lit(False)
    for c in checked or []:
        has_null = has_null | ident(c).isNull()
    # One row per partition of the sort, whatever the size of the data.
    sizes = placed.groupBy(part).agg(
        F.count(F.lit(1)).alias("n"), F.max(has_null).alias("null"),
        F.max(ident(_TIMES) if checked else F.lit(1)).alias("times")).collect()
    if any(s["null"] for s in sizes):
        raise PolicyError(f"the row key {checked} holds nulls")
    if any(s["times"] > 1 for s in sizes):
        raise PolicyError(f"the row key {checked} is not unique")
    sizes = sorted((s[_PART], s["n"]) for s in sizes)
    ends = list(accumulate((n for _, n in sizes), initial=0))
    parts = pa.array([p for p, _ in sizes], pa.int64())
    offsets = local_table(placed.sparkSession, **{_PART: parts, _START: pa.array(ends[:-1], pa.int64())})
    in_part = F.col(_PLACE).bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    ranked = (
        placed.withColumn(_PART, F.shiftright(_PLACE, _PART_BITS))
        .join(F.broadcast(offsets), _PART)
        .withColumn(_RANK, F.col(_START) + in_part)
        .drop(_PART, _PLACE, _START)
    )
    return ranked, ends[-1]


def rank_by_key(df: DataFrame, row_key: list[str], parts: int | None = None) -> tuple[DataFrame, int]:
    """The row keys with their dense rank; they have to be unique and not null.

    Equal keys fall into one range, so they are counted where they are sorted:
    one shuffle ranks the keys and proves that they are unique.
    """
    keys = [ident(k) for k in row_key]
    spread = df.select(*keys).repartitionByRange(*([parts] if parts else []), *keys)
    counted = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias(_TIMES))
    placed = materialize(counted.sortWithinPartitions(*keys).withColumn(_PLACE, F.monotonically_increasing_id()))
    ranked, total = _dense(placed, row_key)
    return ranked.drop(_TIMES), total


def rank_by_draw(drawn: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """The rows with their dense rank in the order of their hex digest.

    Half of the digest, 128 bits, orders the rows; its first bits say which
    partition a row belongs to.
    """
    parts = parts or _usual(drawn.sparkSession)
    first = F.conv(F.substring(_DRAW, 1, _PART_HEX), 16, 10).cast("bigint")
    part = F.shiftright(first * F.lit(parts).cast("bigint"), 4 * _PART_HEX).cast("int")
    half = F.unhex(F.substring(_DRAW, 1, 32))
    spread = drawn.withColumns({_PART: part, _DRAW: half}).repartitionById(parts, _PART)
    placed = spread.sortWithinPartitions(_DRAW).withColumn(_PLACE, F.monotonically_increasing_id())
    return _dense(materialize(placed.drop(_DRAW, _PART)))


def _dealt(df: DataFrame, columns: list[str], row_key: list[str], secrets: Secrets, table: str,
           parts: int | None) -> DataFrame:
    """The row keys of ``df`` with the permuted values, in the order of the columns."""
    rows, total = rank_by_key(df, row_key, parts)
    keys = key_text(df, row_key)
    dealt = rows.repartition(parts, _RANK) if parts else rows  # the values follow
    for i, column in enumerate(columns):
        tag = f"{table}.{column}" if table else column
        drawn = df.select(ident(column).alias(f"__veil_new_{i}"), secrets.draw(tag, keys).alias(_DRAW))
        values, count = rank_by_draw(drawn, parts)
        if count != total:
            raise PolicyError("the table changed while it was shuffled")
        dealt = dealt.join(values, _RANK)
    # 0 for every rank; a literal would be folded into the join's condition, and no rows be dealt by it.
    dealt = dealt.withColumn(_DEALT_PILE, F.least(_RANK, F.lit(0)))
    return dealt.drop(_RANK).withColumnsRenamed({k: f"__veil_key_{i}" for i, k in enumerate(row_key)})


def shuffle_columns(
    df: DataFrame,
    columns: list[str],
    row_key: list[str],
    secrets: Secrets,
    table: str = "",
    scopes: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with each named column permuted on its own.

    ``scopes`` names a boolean column for some of them: only rows where it holds
    are ranked and change places among themselves.  Only row keys and the
    permuted values are ranked; the wide rows move once for each scope, in the
    final join on the row key.
    """
    missing = [c for c in [*columns, *row_key] if c not in df.columns]
    if missing or not row_key:
        raise PolicyError(f"no such columns: {missing}" if missing else "shuffle needs a row key")
    by_scope: dict[str | None, list[str]] = {}
    for column in columns:
        by_scope.setdefault((scopes or {}).get(column), []).append(column)
    out, names, parts = df, df.columns, _parts(df)
    for scope, chosen in by_scope.items():
        subset = df if scope is None else df.filter(ident(scope))
        dealt = _dealt(subset, chosen, row_key, secrets, table, parts)
        keys = {k: f"__veil_key_{i}" for i, k in enumerate(row_key)}
        if parts and scope is not None:
            # Rows out of scope may share a key or have none: they are dealt by the task they come from as well.
            pile = F.when(ident(scope), F.lit(0)).otherwise(F.spark_partition_id() + F.lit(1))
            out, keys = out.withColumn(_PILE, pile.cast("bigint")), {**keys, _PILE: _DEALT_PILE}
        dealt = dealt.repartition(parts, *[ident(k) for k in keys.values()]) if parts else dealt
        condition = F.lit(True) if scope is None else ident(scope)
        for k, found in keys.items():
            condition = condition & (ident(k) == ident(found))
        place = {c: ident(f"__veil_new_{i}") for i, c in enumerate(chosen)}
        if scope is not None:
            place = {c: F.when(ident(scope), new).otherwise(ident(c)) for c, new in place.items()}
        out = out.join(dealt, condition, "inner" if scope is None else "left").select(*[
            place[c].alias(c) if c in place else ident(c) for c in names])
    return out
