"""Checks of a result against its source.  Every audit is a small table."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veil.errors import PolicyError
from veil.functions.build import SUPPRESSED
from veil.functions.canonical import canon, ident
from veil.functions.keyed import local_table
from veil.operators.materialize import materialize

_WAS, _IS = "__veil_was", "__veil_is"


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column and value, counted in one pass over the table."""
    pairs = [
        F.struct(F.lit(c).alias("column"), canon(ident(c), df.schema[c].dataType).alias("value"))
        for c in columns
    ]
    long = df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.column", "pair.value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Values of a column and how often they occur, the most frequent first."""
    counts = df.filter(ident(column).isNotNull()).groupBy(ident(column).alias("value"))
    return counts.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, distinct values, group sizes, share of unique rows."""
    known = F.col("value").isNotNull()
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    return _values(df, columns or df.columns).groupBy("column").agg(
        F.sum(n).alias("rows"),
        F.coalesce(F.sum(F.when(~known, n)), zero).alias("nulls"),
        F.count("value").alias("distinct"),
        F.min(F.when(known, n)).alias("min_group"),
        F.max(F.when(known, n)).alias("max_group"),
        (F.coalesce(F.sum(F.when(known & (n == 1), n)), zero) / F.sum(n)).alias("unique_share"),
    )


def approx_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, nulls and estimated distinct values per column, without a shuffle by value."""
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            (F.count(F.lit(1)) - F.count(ident(c))).alias("nulls"),
            F.approx_count_distinct(ident(c)).alias("approx_distinct"),
        )
        for c in (columns or df.columns)
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def uniqueness(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Whether each column has as many distinct values as it had."""
    old = profile(before, columns).select("column", F.col("distinct").alias("distinct_before"))
    new = profile(after, columns).select("column", F.col("distinct").alias("distinct_after"))
    return old.join(new, "column").withColumn("kept", F.col("distinct_before") == F.col("distinct_after"))


def _moments(df: DataFrame, columns: list[str], by: list[str], suffix: str) -> DataFrame:
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(ident(c)).cast("double").alias(f"mean_{suffix}"),
            F.stddev_samp(ident(c)).alias(f"std_{suffix}"),
        )
        for c in columns
    ]
    grouped = df.groupBy(*[ident(c) for c in by]).agg(F.array(*stats).alias("s"))
    return grouped.select(*[ident(c) for c in by], F.inline("s"))


def drift(
    before: DataFrame,
    after: DataFrame,
    columns: list[str],
    by: list[str] | None = None,
    mean_limit: float = 0.1,
    std_limit: float = 0.3,
) -> DataFrame:
    """Shift of mean and deviation, in shares of the old ones; per segment if asked.

    Null is a segment like any other.  A segment that is new or gone has nulls
    on the other side and is not within the limits.
    """
    by = by or []
    old = _moments(before, columns, by, "before")
    new = _moments(after, columns, by, "after")
    moments = [f"{stat}_{suffix}" for suffix in ("before", "after") for stat in ("mean", "std")]
    sides = old.unionByName(new, allowMissingColumns=True)
    out = sides.groupBy(*[ident(c) for c in by], "column").agg(
        *[F.any_value(m, F.lit(True)).alias(m) for m in moments])

    def shift(name: str) -> Column:
        b, a = F.col(f"{name}_before"), F.col(f"{name}_after")
        return F.try_divide(F.abs(a - b), F.abs(b))

    out = out.withColumns({"mean_shift": shift("mean"), "std_shift": shift("std")})
    within = (F.col("mean_shift") < mean_limit) & (F.col("std_shift") < std_limit)
    return out.withColumn("within", F.coalesce(within, F.lit(False)))


def links(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many child rows and keys find no parent.

    Child keys are counted first, so a key with many rows moves as one row.
    """
    keys = child.filter(ident(child_key).isNotNull()).groupBy(ident(child_key).alias("key"))
    keys = keys.agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(ident(parent_key).alias("key")).distinct().withColumn("found", F.lit(True))
    lost = F.col("found").isNull()
    zero = F.lit(0).cast("bigint")
    return keys.join(known, "key", "left").agg(
        F.coalesce(F.sum("n"), zero).alias("rows"),
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(F.when(lost, F.col("n"))), zero).alias("orphan_rows"),
        F.count(F.when(lost, F.lit(1))).alias("orphan_keys"),
    )


def relationships(before: DataFrame, after: DataFrame, left: str, right: str) -> DataFrame:
    """Rows where two columns are equal, before and after."""
    def equal(df, name):
        return df.agg(F.count_if(ident(left) == ident(right)).alias(name))

    # One row each; the key is the same constant on both sides.
    old = equal(before, "equal_before").withColumn("one", F.lit(1))
    new = equal(after, "equal_after").withColumn("one", F.lit(1))
    return old.join(new, "one").select(
        "equal_before", "equal_after", (F.col("equal_before") == F.col("equal_after")).alias("kept")
    )


def _domains(links: list[tuple[str, str]]) -> dict[str, str]:
    """The least column of each set of linked columns, by column."""
    domains: dict[str, set[str]] = {}
    for left, right in links:
        joined = domains.get(left, {left}) | domains.get(right, {right})
        for column in joined:
            domains[column] = joined
    return {column: min(joined) for column, joined in domains.items()}


def bijections(
    before: dict[str, DataFrame],
    after: dict[str, DataFrame],
    row_keys: dict[str, list[str]],
    links: list[tuple[str, str]],
) -> DataFrame:
    """Whether old and new keys correspond one to one over all linked columns of all tables.

    A link is a pair of ``table.column`` names; columns that are linked, also over
    others, share one ``domain``.  Rows are paired by their row key.  ``merged``
    counts new keys that stand for several old ones, ``split`` old keys that have
    become several, ``lost`` keys that are null on one side only.  Pairs are made
    distinct once; then each way is one aggregate over the pairs.
    """
    domains = _domains([(left, right) for left, right in links])
    pairs = []
    for table in sorted({c.rpartition(".")[0] for c in domains}):
        columns = sorted(c.rpartition(".")[2] for c in domains if c.rpartition(".")[0] == table)
        if table not in before or table not in after:
            raise PolicyError(f"no such table: {table}")
        if not row_keys.get(table):
            raise PolicyError(f"{table} needs a row key that was not anonymized")
        paired = _paired(before[table], after[table], row_keys[table], columns).filter(ident(_WAS) & ident(_IS))
        pairs.append(paired.select(F.inline(F.array(*[
            F.struct(F.lit(domains[f"{table}.{c}"]).alias("domain"),
                     canon(ident(f"old {c}"), before[table].schema[c].dataType).alias("old"),
                     canon(ident(f"new {c}"), after[table].schema[c].dataType).alias("new")) for c in columns]))))
    if not pairs:
        raise PolicyError("there must be a link")
    distinct = materialize(reduce(DataFrame.unionByName, pairs).distinct())
    known = distinct.filter("old IS NOT NULL AND new IS NOT NULL")

    def several(key: str, keys: str, many: str) -> DataFrame:
        return known.groupBy("domain", key).agg(F.count(F.lit(1)).alias("n")).groupBy("domain").agg(
            F.count(F.lit(1)).alias(keys), F.count_if(F.col("n") > 1).alias(many))

    lost = distinct.groupBy("domain").agg(F.count_if(F.col("old").isNull() != F.col("new").isNull()).alias("lost"))
    out = lost.join(several("old", "keys", "split"), "domain", "left").join(
        several("new", "codes", "merged"), "domain", "left").fillna(0, ["keys", "split", "codes", "merged"])
    holds = (F.col("split") == 0) & (F.col("merged") == 0) & (F.col("lost") == 0)
    return out.select("domain", "keys", "codes", "merged", "split", "lost", holds.alias("holds"))


def _paired(before: DataFrame, after: DataFrame, row_key: list[str], columns: list[str]) -> DataFrame:
    """Old and new values side by side; the row key is unique and not anonymized.

    Rows of one side alone stay, with ``was`` or ``is`` null and no values of the
    other side; so do rows whose key has a null.
    """
    missing = [c for c in [*row_key, *columns] if c not in before.columns or c not in after.columns]
    if missing:
        raise PolicyError(f"not in both tables: {missing}")
    here = F.lit(True)
    old = before.select(
        *[ident(k) for k in row_key], here.alias(_WAS), *[ident(c).alias(f"old {c}") for c in columns])
    new = after.select(
        *[ident(k) for k in row_key], here.alias(_IS), *[ident(c).alias(f"new {c}") for c in columns])
    return old.join(new, row_key, "full")


def _unpaired() -> list[Column]:
    """How many rows are in one table only."""
    return [F.count_if(ident(_IS).isNull()).alias("missing_rows"), F.count_if(ident(_WAS).isNull()).alias("extra_rows")]


def digit_run(old: Column, new: Column, length: int) -> Column:
    """Whether ``length`` digits in a row of the old text are in the new one."""
    a = F.regexp_replace(old, "[^0-9]", "")
    b = F.regexp_replace(new, "[^0-9]", "")
    starts = F.when(
        F.length(a) >= length, F.sequence(F.lit(1), F.length(a) - F.lit(length - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.instr(b, F.substring(a, i, F.lit(length))) > 0)


def leaks(
    before: DataFrame, after: DataFrame, row_key: list[str], columns: list[str], digits: int | None = None
) -> DataFrame:
    """Rows whose output equals the input or, if asked, keeps a run of its digits; rows without a partner are counted."""
    pairs = _paired(before, after, row_key, columns)
    both = ident(_WAS) & ident(_IS)
    stats = []
    for c in columns:
        old = canon(ident(f"old {c}"), before.schema[c].dataType)
        new = canon(ident(f"new {c}"), after.schema[c].dataType)
        run = digit_run(old, new, digits) if digits else F.lit(None).cast("boolean")
        stats.append(F.struct(
            F.lit(c).alias("column"),
            F.count(F.when(both, old)).alias("values"),
            F.count_if(old == new).alias("unchanged"),
            F.count_if(run).alias("digit_runs"),
            *_unpaired(),
        ))
    return pairs.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def noise(before: DataFrame, after: DataFrame, row_key: list[str], columns: list[str]) -> DataFrame:
    """Bounds, centre and variation of what was added to each column; rows without a partner are counted."""
    pairs = _paired(before, after, row_key, columns)
    stats = []
    for c in columns:
        added = ident(f"new {c}").cast("double") - ident(f"old {c}").cast("double")
        stats.append(F.struct(
            F.lit(c).alias("column"),
            F.count(added).alias("values"),
            F.min(added).alias("min_noise"),
            F.max(added).alias("max_noise"),
            F.avg(added).alias("mean_noise"),
            F.stddev_samp(added).alias("std_noise"),
            *_unpaired(),
        ))
    return pairs.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def k_threshold(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Per asked column the smallest group of values that were not suppressed; null if none is left."""
    n = F.when(F.col("value") != SUPPRESSED, F.col("n"))
    kept = _values(df, columns).groupBy("column").agg(
        F.count(n).alias("values"), F.min(n).alias("min_group"), F.count_if(n < k).alias("below_k"))
    asked = local_table(df.sparkSession, column=pa.array(columns, pa.string()))
    return asked.join(kept, "column", "left").fillna(0, ["values", "below_k"]).withColumn(
        "holds", F.col("below_k") == 0)


def class_sizes(df: DataFrame, quasi_ids: list[str]) -> DataFrame:
    """How many classes of equal quasi-identifiers have which size."""
    classes = df.groupBy(*[ident(c) for c in quasi_ids]).agg(F.count(F.lit(1)).alias("size"))
    return classes.groupBy("size").agg(F.count(F.lit(1)).alias("classes")).withColumn(
        "rows", F.col("size") * F.col("classes")
    )


def class_sizes_by_subset(df: DataFrame, quasi_ids: list[str]) -> DataFrame:
    """Smallest class and number of classes for every subset of the quasi-identifiers.

    Only the classes of all of them are multiplied by the subsets, not the rows.
    """
    keys = [ident(c) for c in quasi_ids]
    classes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__veil_n"))
    cube = classes.cube(*keys).agg(F.grouping_id().alias("left_out"), F.sum("__veil_n").alias("size"))
    return cube.groupBy("left_out").agg(
        F.count(F.lit(1)).alias("classes"), F.min("size").alias("min_class")
    )


def privacy_report(df: DataFrame, quasi_ids: list[str], sensitive: str | None = None) -> DataFrame:
    """Class sizes, re-identification risk and diversity of the sensitive column.

    Distinct sensitive values are found by grouping on class and value first, so
    a class that holds much of the table is combined before the shuffle.
    """
    keys = [ident(c) for c in quasi_ids]
    value = ident(sensitive) if sensitive else F.lit(None).cast("string")
    pairs = df.groupBy(*keys, value.alias("__veil_value")).agg(F.count(F.lit(1)).alias("n"))
    classes = pairs.groupBy(*keys).agg(
        F.sum("n").alias("size"), F.count("__veil_value").alias("diversity")
    )
    size = F.col("size")
    return classes.agg(
        F.coalesce(F.sum(size), F.lit(0).cast("bigint")).alias("rows"),
        F.count(F.lit(1)).alias("classes"),
        F.min(size).alias("min_class"),
        F.max(size).alias("max_class"),
        F.count_if(size == 1).alias("unique_rows"),
        F.try_divide(F.lit(1.0), F.min(size)).alias("max_risk"),
        F.try_divide(F.count(F.lit(1)), F.sum(size)).alias("mean_risk"),
        F.min("diversity").alias("min_diversity"),
    )


def _weighted(base: DataFrame, numbers: dict[str, str]) -> DataFrame:
    """(column, side, mean, std) over groups of which each has its count, mean and sum of squares.

    Deviations are added up from the means of the groups, which loses no digits
    as a difference of large sums of squares would.
    """
    parts = base.select(F.inline(F.array(*[
        F.struct(F.lit(column).alias("column"), F.lit(side).alias("side"), F.col(f"n_{key}").alias("n"),
                 F.col(f"mean_{key}").alias("mean"), F.col(f"var_{key}").alias("var"))
        for i, column in enumerate(numbers) for side, key in (("before", f"b{i}"), ("after", f"a{i}"))]))).filter("n > 0")
    centre = parts.groupBy("column", "side").agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre"))
    off = F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("centre"), 2))
    return parts.join(F.broadcast(centre), ["column", "side"]).groupBy("column", "side").agg(
        F.any_value("centre").alias("mean"), F.sqrt(F.try_divide(F.sum(off), F.sum("n") - 1)).alias("std"))


def full_report(
    df: DataFrame, quasi_ids: list[str], sensitive: str | None = None, numbers: dict[str, str] | None = None
) -> DataFrame:
    """Everything about the privacy of a table in one pass: (section, item, value).

    The table is read once, grouped by quasi-identifiers and sensitive value, and
    that aggregate is stored.  From it come

    * ``classes``: their number, rows, smallest and largest size;
    * ``histogram``: how many classes have a size;
    * ``risk``: of the smallest class, on average, and rows that are alone;
    * ``diversity``: least distinct sensitive values and largest share of one value
      in a class; ``closeness``: largest distance of a class's values from all;
    * ``subset``, ``subset_classes``, ``unique``: for each subset of the quasi-identifiers
      its smallest class, its classes and those of one row;
    * ``mean_shift``, ``std_shift``: for each pair of an old and a new column in
      ``numbers`` the shift as a share of the old figure.
    """
    numbers = numbers or {}
    missing = [c for c in [*quasi_ids, *([sensitive] if sensitive else []), *numbers, *numbers.values()]
               if c not in df.columns]
    if missing or not quasi_ids:
        raise PolicyError(f"no such columns: {missing}" if missing else "name the quasi-identifiers")
    keys = [f"q{i}" for i in range(len(quasi_ids))]
    value = ident(sensitive) if sensitive else F.lit(None).cast("string")
    moments = []
    for i, (old, new) in enumerate(numbers.items()):
        for key, c in ((f"b{i}", old), (f"a{i}", new)):
            x = ident(c).cast("double")
            moments += [F.count(x).alias(f"n_{key}"), F.avg(x).alias(f"mean_{key}"), F.var_pop(x).alias(f"var_{key}")]
    base = materialize(df.groupBy(*[ident(c).alias(k) for c, k in zip(quasi_ids, keys, strict=True)],
                                  value.alias("v")).agg(F.count(F.lit(1)).alias("n"), *moments))

    total = base.agg(F.sum("n").alias("total"))
    overall = base.groupBy("v").agg(F.sum("n").alias("of_value"))
    # Half of the summed differences of shares; a value that the class lacks differs by its whole share, so only values
    # it has are looked at: the distance is the sum of what the class has too much.
    shared = base.select(*keys, "v", "n").join(overall, base["v"].eqNullSafe(overall["v"])).drop(overall["v"]).join(
        F.broadcast(total))
    sized = base.groupBy(*keys).agg(F.sum("n").alias("size"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s_{k}"))
    excess = F.greatest(F.col("n") / F.col("size") - F.col("of_value") / F.col("total"), F.lit(0.0))
    classes = materialize(shared.join(sized.withColumnsRenamed({k: f"s_{k}" for k in keys}), same).groupBy(*keys).agg(
        F.any_value("size").alias("size"), F.count("v").alias("distinct"),
        F.max(F.col("n") / F.col("size")).alias("largest"), F.sum(excess).alias("distance")))

    def rows(df: DataFrame, **items) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(item).cast("string").alias("item"),
                     F.col(column).cast("double").alias("value"))
            for column, (section, item) in items.items()])))

    size = F.col("size")
    sums = classes.agg(
        F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum(size), F.lit(0)).alias("rows"), F.min(size).alias("least"),
        F.max(size).alias("most"), F.try_divide(F.lit(1.0), F.min(size)).alias("max_risk"),
        F.try_divide(F.count(F.lit(1)), F.sum(size)).alias("mean_risk"), F.count_if(size == 1).alias("alone"),
        F.min("distinct").alias("distinct"), F.max("largest").alias("share"), F.max("distance").alias("distance"))
    out = rows(sums, classes=("classes", "count"), rows=("classes", "rows"), least=("classes", "min"), most=("classes", "max"),
               max_risk=("risk", "max"), mean_risk=("risk", "mean"), alone=("risk", "unique_rows"))
    if sensitive:
        out = out.unionByName(rows(sums, distinct=("diversity", "min_distinct"), share=("diversity", "max_share"),
                                   distance=("closeness", "max")))
    out = out.unionByName(classes.groupBy("size").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("histogram").alias("section"), F.col("size").cast("string").alias("item"), "value"))
    # Only classes are multiplied by the subsets, not rows.
    cube = classes.cube(*keys).agg(F.grouping_id().alias("left_out"), F.sum("size").alias("size"))
    bits = [F.when(F.shiftright("left_out", len(keys) - 1 - i) % 2 == 0, c) for i, c in enumerate(quasi_ids)]
    subsets = cube.groupBy(F.concat_ws(",", *bits).alias("item")).agg(
        F.min("size").alias("least"), F.count(F.lit(1)).alias("classes"), F.count_if(size == 1).alias("alone"))
    out = out.unionByName(subsets.filter("item != ''").select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.col("item").alias("item"), F.col(c).cast("double").alias("value"))
        for c, section in (("least", "subset"), ("classes", "subset_classes"), ("alone", "unique"))]))))
    if numbers:
        sides = _weighted(base, numbers).groupBy("column").agg(*[
            F.max(F.when(F.col("side") == side, F.col(stat))).alias(f"{stat}_{side}")
            for side in ("before", "after") for stat in ("mean", "std")])
        shifts = [F.struct(F.lit(f"{stat}_shift").alias("section"), F.col("column").alias("item"), F.try_divide(
            F.abs(F.col(f"{stat}_after") - F.col(f"{stat}_before")), F.abs(f"{stat}_before")).alias("value"))
            for stat in ("mean", "std")]
        out = out.unionByName(sides.select(F.inline(F.array(*shifts))))
    return out
