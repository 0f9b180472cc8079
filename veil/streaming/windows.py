"""Cross-row methods on streams.

Row methods need nothing of this: ``anonymize`` takes a stream as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from veil.errors import PolicyError
from veil.functions.canonical import canon, ident
from veil.functions.keyed import Secrets
from veil.operators.lookup import attach
from veil.operators.materialize import temporary_tables
from veil.operators.permutation import shuffle_columns
from veil.operators.suppression import flag_frequent, suppressed
from veil.settings import Settings

_WINDOW = "__veil_window"
_FLAG = "__veil_keep"


def _event_time(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need an instant: a time without a zone is read in the session's."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        return df.withColumn(time, ident(time).cast("timestamp"))
    return df


def _result(df: DataFrame, columns: list[str], target: str, dtype) -> DataFrame:
    c: Column = suppressed(ident(target), dtype, _FLAG)
    return df.select(*[c.alias(x) if x == target else ident(x) for x in columns])


def windowed_k_anonymity(
    df: DataFrame,
    time: str,
    window: str,
    column: str,
    k: int,
    row_key: list[str],
    delay: str = "0 seconds",
    spread: int = 16,
) -> DataFrame:
    """Suppress values that occur less than ``k`` times in their tumbling window.

    On a stream rows leave once their window is closed, and rows that come after
    that are dropped, so none leaves before its group is known.  The counts are
    combined before their shuffle, and the rows of one value are spread over
    ``spread`` tasks by their row key, each of which gets a copy of the count.
    A row without an event time belongs to no window, so its value is suppressed.
    """
    missing = [c for c in [time, column, *row_key] if c not in df.columns]
    if missing or not row_key:
        raise PolicyError(f"no such columns: {missing}" if missing else "name the row key")
    columns, dtype = df.columns, df.schema[column].dataType
    timeless = _result(df.filter(ident(time).isNull()).withColumn(_FLAG, F.lit(False)), columns, column, dtype)
    df = df.filter(ident(time).isNotNull())
    if not df.isStreaming:
        scoped = df.withColumn(_WINDOW, F.window(ident(time), window).getField("start"))
        flagged = flag_frequent(scoped, [_WINDOW, column], k, _FLAG)
        return _result(flagged, columns, column, dtype).unionByName(timeless)

    timeless = _event_time(timeless, time) if time != column else timeless
    df = _event_time(df, time).withWatermark(time, delay)
    text = canon(ident(column), dtype)
    group = {"__veil_value": F.coalesce(text, F.lit("")), "__veil_null": text.isNull()}
    span = F.window(ident(time), window).alias(_WINDOW)
    # A stream may carry one event time only: here the window, so the time is copied.
    plain = F.timestamp_micros(F.unix_micros(ident(time))).alias(time)
    salt = F.pmod(F.xxhash64(*[ident(c) for c in row_key]), F.lit(spread)).cast("int")
    rows = df.select(
        *[plain if c == time else ident(c) for c in columns],
        *[c.alias(n) for n, c in group.items()],
        span,
        salt.alias("__veil_salt"),
    )
    counts = df.groupBy(span, *[c.alias(n) for n, c in group.items()]).agg(F.count(F.lit(1)).alias("__veil_n"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__veil_salt")
    counts = counts.select(_WINDOW, *group, (F.col("__veil_n") >= k).alias(_FLAG), salts)
    joined = rows.join(counts, [_WINDOW, *group, "__veil_salt"])
    return _result(joined, columns, column, dtype).unionByName(timeless)


def _micros(spark: SparkSession, duration: str) -> int:
    """The length of an interval such as ``30 minutes``."""
    end = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{duration}')")
    micros = spark.range(1).select(end).first()[0]
    if micros <= 0:
        raise PolicyError(f"not a duration: {duration}")
    return micros


def session_k_anonymity(
    df: DataFrame,
    time: str,
    gap: str,
    column: str,
    k: int,
    row_key: list[str],
    longest: str = "1 day",
    delay: str = "0 seconds",
    spread: int = 16,
) -> DataFrame:
    """Suppress values in sessions of less than ``k`` rows.

    A session is a run of rows of one value, each at most ``gap`` after the one
    before.  It ends in any case where the next stretch of ``longest`` begins,
    counted from 1970, so that a stream need not keep rows for ever.  A stretch
    falls into cells as long as the gap: rows of a value in one cell are always in
    one session, so rows find their session by their cell, never by comparing it
    with all sessions of the value.

    On a stream rows leave once their session is closed.  A late row leaves only
    if it falls into a session that is known.  Rows of one cell are spread over
    ``spread`` tasks.  A row without an event time has no session, so its value
    is suppressed.
    """
    missing = [c for c in [time, column, *row_key] if c not in df.columns]
    if missing or not row_key:
        raise PolicyError(f"no such columns: {missing}" if missing else "name the row key")
    pause, stretch = _micros(df.sparkSession, gap), _micros(df.sparkSession, longest)
    if pause > stretch:
        raise PolicyError("the gap must not be longer than the longest session")
    columns, dtype = df.columns, df.schema[column].dataType
    timeless = _result(df.filter(ident(time).isNull()).withColumn(_FLAG, F.lit(False)), columns, column, dtype)
    text = canon(ident(column), dtype)
    group = {"__veil_value": F.coalesce(text, F.lit("")), "__veil_null": text.isNull()}
    df = _event_time(df, time) if df.isStreaming else df
    timeless = _event_time(timeless, time) if df.isStreaming and time != column else timeless
    micros = F.unix_micros(ident(time).cast("timestamp"))

    def stretch_of(us: Column) -> Column:
        return F.floor(us / F.lit(stretch))

    def cell_of(us: Column) -> Column:
        return F.floor(F.pmod(us, F.lit(stretch)) / F.lit(pause))

    cell = {"__veil_stretch": stretch_of(micros), "__veil_cell": cell_of(micros)}
    timed = df.filter(ident(time).isNotNull())
    if not df.isStreaming:
        keyed = timed.withColumns({**group, **cell})
        value = [*group, "__veil_stretch"]
        cells = keyed.groupBy(*value, "__veil_cell").agg(
            F.min(micros).alias("first"), F.max(micros).alias("last"), F.count(F.lit(1)).alias("n"))
        # A value has at most stretch / gap cells in a stretch, however many rows it has.
        in_order = Window.partitionBy(*value).orderBy("__veil_cell")
        before = F.lag("last").over(in_order)
        begins = F.when(before.isNull() | (F.col("first") - before > pause), 1).otherwise(0)
        cells = cells.withColumn("begins", begins).withColumn("session", F.sum("begins").over(in_order))
        total = F.sum("n").over(Window.partitionBy(*value, "session"))
        flags = cells.select(*value, "__veil_cell", (total >= k).alias(_FLAG))
        flagged = attach(keyed, [*value, "__veil_cell"], flags)
        return _result(flagged, columns, column, dtype).unionByName(timeless)

    names = list(group)
    sessions = timed.withWatermark(time, delay).groupBy(
        F.session_window(ident(time), gap).alias(_WINDOW), stretch_of(micros).alias("__veil_stretch"),
        *[c.alias(n) for n, c in group.items()],
    ).agg(F.count(F.lit(1)).alias("n"))
    # The window ends one gap after the last row.
    first = F.unix_micros(F.col(f"{_WINDOW}.start"))
    last = F.unix_micros(F.col(f"{_WINDOW}.end")) - pause
    # A session of the stretch is closed one gap after the end of the stretch; till then its rows are kept.
    due = F.timestamp_micros((F.col("__veil_stretch") + 1) * stretch + pause)
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__veil_salt")
    known = sessions.select(
        *names, due.alias("__veil_due"), (F.col("n") >= k).alias(_FLAG),
        F.explode(F.sequence(cell_of(first), cell_of(last))).alias("__veil_cell"),
    ).select("*", salts)
    salt = F.pmod(F.xxhash64(*[ident(c) for c in row_key]), F.lit(spread)).cast("int")
    rows = timed.select("*", *[c.alias(n) for n, c in {**group, **cell}.items()], salt.alias("__veil_salt")).withColumn(
        "__veil_due", due).withWatermark("__veil_due", delay).drop("__veil_stretch")
    joined = rows.join(known, [*names, "__veil_due", "__veil_cell", "__veil_salt"])
    return _result(joined, columns, column, dtype).unionByName(timeless)


def shuffle_batches(
    df: DataFrame,
    columns: list[str],
    row_key: list[str],
    settings: Settings,
    sink: Callable[[DataFrame, int], None],
    table: str = "",
) -> DataStreamWriter:
    """Permute columns within each micro-batch and hand the batch to ``sink``.

    The scope of a permutation is one batch.  The batch number is part of the
    draw, so batches are permuted independently and a repeated batch alike.
    The sink has to write the batch; what was stored for it is deleted after.
    """

    def run(batch: DataFrame, number: int) -> None:
        secrets = Secrets(batch.sparkSession, settings)
        with temporary_tables(batch.sparkSession):
            sink(shuffle_columns(batch, columns, row_key, secrets, f"{table}#{number}"), number)

    return df.writeStream.foreachBatch(run)
