"""Summaries of columns that can be stored, merged and compared without the values.

A table is read once; what is left of a column is one sketch of bounded size for
each segment.  Sketches of chunks, days or tables are merged later, so that
uniqueness, overlap and drift are known for all of them together and no value is
ever shuffled.  The error of a sketch depends on its size alone.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from veil.errors import PolicyError
from veil.functions.canonical import canon, ident
from veil.operators.materialize import materialize

#: Distinct values kept of a column: 2 to this power; up to so many the count is exact.
DISTINCT_BITS = 14
#: Size of a quantile sketch.
QUANTILE_SIZE = 400
QUARTILES = (0.25, 0.75)


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Relative error of a count that 997 of 1000 sketches keep to: three standard errors."""
    return 3 / sqrt(2**bits)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """Error of a quantile's rank, as a share of the rows, that 99 of 100 quantiles keep to."""
    return 2.296 / size**0.9723


def _union(tables: list[DataFrame]) -> DataFrame:
    if not tables:
        raise PolicyError("there must be a table of sketches")
    return reduce(DataFrame.unionByName, tables)


def _by(df: DataFrame, *own: str) -> list[Column]:
    """The segment columns of a table of sketches."""
    return [ident(c) for c in df.columns if c not in own]


# --- distinct values --------------------------------------------------------------

_DISTINCT = ("column", "rows", "nulls", "sketch")


def distinct_sketches(
    df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None, bits: int = DISTINCT_BITS
) -> DataFrame:
    """Per segment and column: ``rows``, ``nulls`` and a sketch of the distinct values.  One pass, combined in each task."""
    by = by or []
    names = columns or [c for c in df.columns if c not in by]
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(ident(c).isNull()).alias("nulls"),
            F.theta_sketch_agg(canon(ident(c), df.schema[c].dataType), bits).alias("sketch"),
        )
        for c in names
    ]
    keys = [ident(c) for c in by]
    return df.groupBy(*keys).agg(F.array(*stats).alias("__veil_s")).select(*keys, F.inline("__veil_s"))


def merge_distinct(tables: list[DataFrame], by: list[str] | None = None, bits: int = DISTINCT_BITS) -> DataFrame:
    """The sketches of several tables as one, per column and, if asked, per segment.

    A value that several of them have counts once.
    """
    keys = [ident(c) for c in by or []]
    merged = _union(tables).groupBy(*keys, "column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.theta_union_agg("sketch", bits).alias("sketch"))
    return merged.select(*keys, *_DISTINCT)


def estimated_profile(sketches: DataFrame) -> DataFrame:
    """Rows, nulls and estimated distinct values."""
    return sketches.select(*_by(sketches, *_DISTINCT), "column", "rows", "nulls",
                           F.theta_sketch_estimate("sketch").alias("distinct"))


def estimated_uniqueness(before: DataFrame, after: DataFrame, bits: int = DISTINCT_BITS) -> DataFrame:
    """Whether columns have as many distinct values as they had, as far as their sketches can tell.

    A column that only one side has is not kept.
    """
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return estimated_profile(df).select(*_by(df, *_DISTINCT), "column", F.col("distinct").alias(f"distinct_{suffix}"))

    keys = [c for c in before.columns if c not in _DISTINCT] + ["column"]
    sides = side(before, "before").unionByName(side(after, "after"), allowMissingColumns=True)
    out = sides.groupBy(*[ident(k) for k in keys]).agg(
        *[F.max(f"distinct_{s}").alias(f"distinct_{s}") for s in ("before", "after")])
    b, a = F.col("distinct_before"), F.col("distinct_after")
    # Up to the size of a sketch counts are exact and have to be equal.
    kept = F.when(F.greatest(b, a) < 2**bits, b == a).otherwise(
        F.abs(b - a) <= F.greatest(b, a) * (2 * distinct_error(bits)))
    return out.withColumn("kept", F.coalesce(kept & b.isNotNull() & a.isNotNull(), F.lit(False)))


def estimated_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many distinct values two columns share: ``column``, ``other``, both counts and ``shared``.

    The error of ``shared`` is a share of all values of both columns together.
    """
    a = left.groupBy("column").agg(F.theta_union_agg("sketch").alias("a"))
    b = right.groupBy(F.col("column").alias("other")).agg(F.theta_union_agg("sketch").alias("b"))
    # One row per column on each side.
    pairs = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")
    return pairs.select(
        "column", "other", F.theta_sketch_estimate("a").alias("values"), F.theta_sketch_estimate("b").alias("other_values"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("shared"))


# --- quantiles --------------------------------------------------------------------

_QUANTILE = ("column", "n", "sketch")


def _numbers(df: DataFrame, columns: list[str]) -> list[Column]:
    """Numeric columns; values that are no numbers count as missing."""
    return [F.nanvl(ident(c).cast("double"), F.lit(None).cast("double")) for c in columns]


def quantile_sketches(
    df: DataFrame, columns: list[str], by: list[str] | None = None, size: int = QUANTILE_SIZE
) -> DataFrame:
    """Per segment and column: ``n`` numbers and a sketch of their order.  One pass, combined in each task."""
    keys = [ident(c) for c in by or []]
    stats = [F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.kll_sketch_agg_double(x, size).alias("sketch"))
             for c, x in zip(columns, _numbers(df, columns), strict=True)]
    return df.groupBy(*keys).agg(F.array(*stats).alias("__veil_s")).select(*keys, F.inline("__veil_s"))


def merge_quantiles(tables: list[DataFrame], by: list[str] | None = None, size: int = QUANTILE_SIZE) -> DataFrame:
    """The sketches of several tables as one, per column and, if asked, per segment."""
    keys = [ident(c) for c in by or []]
    merged = _union(tables).groupBy(*keys, "column").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))
    return merged.select(*keys, *_QUANTILE)


def estimated_quantiles(sketches: DataFrame, at: list[float]) -> DataFrame:
    """(segment, column, quantile, value) read from the sketches; a column without numbers has no rows."""
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("quantile"),
                               F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in at])
    keys = _by(sketches, *_QUANTILE)
    return sketches.filter("n > 0").select(*keys, "column", F.inline(pairs))


def exact_quantiles(df: DataFrame, columns: list[str], by: list[str], at: list[float]) -> DataFrame:
    """(segment, column, quantile, value): the least value that has the share of the numbers at or below it.

    Equal values are counted first; the counts are sorted over all tasks and
    summed, so that no task holds a column or a segment.
    """
    long = df.select(*[ident(c) for c in by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), x.alias("value"))
        for c, x in zip(columns, _numbers(df, columns), strict=True)]))).filter("value IS NOT NULL")
    group = [*[ident(c) for c in by], F.col("column")]
    part = "__veil_part"
    counts = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(counts.repartitionByRange(*group, "value").sortWithinPartitions(*group, "value").withColumn(
        part, F.spark_partition_id()))
    # One row for each partition and the segments in it.
    sums = placed.groupBy(part, *group).agg(F.sum("n").alias("in_part"))
    order = Window.partitionBy(*group).orderBy(part)
    offsets = sums.select(
        F.col(part).alias("p"), F.struct(*group).alias("group"),
        (F.sum("in_part").over(order) - F.col("in_part")).alias("before"),
        F.sum("in_part").over(Window.partitionBy(*group)).alias("total"))
    here = Window.partitionBy(part, *group).orderBy("value")
    ranked = placed.withColumn("upto", F.sum("n").over(here))
    joined = ranked.join(offsets, (ident(part) == F.col("p")) & F.struct(*group).eqNullSafe(F.col("group"))).drop("p")
    last = F.col("before") + F.col("upto")

    def reached(q: Column) -> Column:
        target = F.greatest(F.ceil(q * F.col("total")), F.lit(1))
        return (last >= target) & (last - F.col("n") < target)

    quantiles = F.filter(F.array(*[F.lit(float(q)) for q in at]), reached)
    return joined.select(*group, F.explode(quantiles).alias("quantile"), "value")


def quantile_drift(
    before: DataFrame,
    after: DataFrame,
    columns: list[str],
    by: list[str] | None = None,
    at: tuple[float, ...] = (0.05, 0.5, 0.95),
    limit: float = 0.1,
    size: int = QUANTILE_SIZE,
    exact: bool = False,
) -> DataFrame:
    """Shift of quantiles as a share of the old distance between the quartiles; per segment if asked.

    ``before`` and ``after`` are tables, or their sketches by ``quantile_sketches``
    if these were stored.  Quantiles of sketches keep to ``rank_error(size)``.
    A segment that is new or gone has nulls on the other side and is not within
    the limit; so is one without a distance between its quartiles, unless nothing
    moved.
    """
    by = by or []
    wanted = sorted({*at, *QUARTILES})

    def side(df: DataFrame, suffix: str) -> DataFrame:
        if exact:
            found = exact_quantiles(df, columns, by, wanted)
        elif "sketch" in df.columns:
            found = estimated_quantiles(merge_quantiles([df], by, size), wanted)
        else:
            found = estimated_quantiles(quantile_sketches(df, columns, by, size), wanted)
        return found.withColumnRenamed("value", suffix)

    keys = [ident(c) for c in by]
    sides = side(before, "before").unionByName(side(after, "after"), allowMissingColumns=True)
    paired = sides.groupBy(*keys, "column", "quantile").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    # A handful of rows for each segment and column.
    group = Window.partitionBy(*keys, "column")
    low, high = (F.max(F.when(F.col("quantile") == q, F.col("before"))).over(group) for q in QUARTILES)
    moved = F.abs(F.col("after") - F.col("before"))
    out = paired.withColumn("spread", high - low).withColumn(
        "shift", F.when(moved == 0, 0.0).otherwise(F.try_divide(moved, F.col("spread"))))
    return out.filter(F.col("quantile").isin(*[float(q) for q in at])).drop("spread").withColumn(
        "within", F.coalesce(F.col("shift") <= limit, F.lit(False)))
