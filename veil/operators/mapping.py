"""Pseudonyms without collisions, dictionary replacement and value hierarchies."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.errors import PolicyError
from veil.functions.build import REDACTED
from veil.functions.canonical import canon, ident
from veil.functions.keyed import Secrets, local_table
from veil.operators.lookup import attach
from veil.operators.materialize import materialize
from veil.settings import Settings

_DIGEST = 64
_SHORTEST = 4  # below this, too many values would share a code to compare them in one task
_VALUE = "__veil_value"


def _widths(width: int) -> list[int]:
    """The lengths a code may have: ``width`` digits, doubled up to the whole digest."""
    if not _SHORTEST <= width <= _DIGEST:
        raise PolicyError(f"width must be {_SHORTEST} to {_DIGEST}")
    widths = [width]
    while widths[-1] < _DIGEST:
        widths.append(min(2 * widths[-1], _DIGEST))
    return widths


def _distinct_values(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    if not sources:
        raise PolicyError("there must be a source")
    columns = [df.select(canon(ident(c), df.schema[c].dataType).alias("value")) for df, c in sources]
    return reduce(DataFrame.unionByName, columns).filter("value IS NOT NULL").distinct()


def _coded(digests: DataFrame, prefix: str, widths: list[int]) -> DataFrame:
    """``value``, ``code``, ``widened``, ``digest`` of the rows with a value in (value, digest).

    At each length the digests are counted by their first digits, combined in
    each task; values that are alone with theirs are done.  Only the others, and
    the digests they share digits with, go on to the next length.  Rows without a value
    take digits but get no code.
    """
    parts, rest = [], digests
    for width in widths:
        start = F.substring("digest", 1, width)
        code = F.concat(F.lit(f"{prefix}_"), start).alias("code")
        named = "value", code, F.lit(width > widths[0]).alias("widened"), "digest"
        if width == _DIGEST:
            parts.append(rest.filter("value IS NOT NULL").select(*named))
            break
        shared = rest.groupBy(start.alias("start")).agg(
            F.count(F.lit(1)).alias("n"), F.count("value").alias("named")).filter("n > 1 AND named > 0")
        marked = attach(rest.withColumn("start", start), ["start"], materialize(shared))
        alone = F.col("n").isNull()
        parts.append(marked.filter(alone & F.col("value").isNotNull()).select(*named))
        # Few are left: with 8 digits about the square of the number of values by 8.6 billion.
        rest = materialize(marked.filter(~alone).select("value", "digest"))
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def build_vault(
    sources: list[tuple[DataFrame, str]], settings: Settings, prefix: str = "ID", width: int = 8
) -> DataFrame:
    """One code per distinct value of all sources: ``value``, ``code``, ``widened``.  It is stored.

    A code is the shortest of the first 1, 2, 4, ... times ``width`` digits of
    the digest that no other value shares.
    """
    widths, values = _widths(width), _distinct_values(sources)
    secrets = Secrets(values.sparkSession, settings)
    digests = materialize(values.withColumn("digest", secrets.digest(F.col("value"))))
    return materialize(_coded(digests, prefix, widths).drop("digest"))


_VERSIONED = "value string, code string, widened boolean, digest string"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were written to the end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))]
    numbers = [int(n.removeprefix("version=")) for n in names if re.fullmatch(r"version=\d+", n)]
    return sorted(n for n in numbers if fs.exists(hadoop(f"{path}/version={n}/_SUCCESS")))


def read_vault(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``value``, ``code``, ``widened``, ``version`` and ``digest`` of a grown vault, as it was at a version or as it is."""
    known = _versions(spark, path)
    if version is not None and version not in known:
        raise PolicyError(f"{path} has no version {version}")
    parts = [spark.read.schema(_VERSIONED).parquet(f"{path}/version={n}").withColumn("version", F.lit(n))
             for n in known if version is None or n <= version]
    if not parts:
        return spark.createDataFrame([], f"{_VERSIONED}, version int")
    return reduce(DataFrame.unionByName, parts)


def grow_vault(
    spark: SparkSession,
    path: str,
    sources: list[tuple[DataFrame, str]],
    settings: Settings,
    prefix: str = "ID",
    width: int = 8,
) -> DataFrame:
    """Give codes to values that the vault at ``path`` does not have, as its next version; returns the whole vault.

    A version is never changed once it is written, so old codes stay.  A new code
    is the shortest part of the digest whose digits no other value begins with,
    old or new; an old value keeps its shorter code when a new one shares its
    digits.  Without new values there is no new version.  What a run that failed
    left behind is written over.  One run at a time may grow a vault.
    """
    widths, path = _widths(width), path.rstrip("/")
    old = read_vault(spark, path)
    secrets = Secrets(spark, settings)
    new = materialize(_distinct_values(sources).join(old.select("value"), "value", "left_anti").withColumn(
        "digest", secrets.digest(F.col("value"))))
    if new.isEmpty():
        return old
    taken = old.select(F.lit(None).cast("string").alias("value"), "digest")
    out = _coded(new.unionByName(taken), prefix, widths)
    out.write.mode("overwrite").parquet(f"{path}/version={max(_versions(spark, path), default=0) + 1}")
    return read_vault(spark, path)


def apply_vault(
    df: DataFrame, column: str, vault: DataFrame, settings: Settings, prefix: str = "ID"
) -> DataFrame:
    """Replace a column by its vault codes.

    A value that the vault does not have gets its whole digest, which no other
    value has; a short code might be another value's.
    """
    text = canon(ident(column), df.schema[column].dataType)
    whole = Secrets(df.sparkSession, settings).digest(F.col(_VALUE))
    codes = vault.select(F.col("value").alias(_VALUE), F.col("code").alias("__veil_code"))
    out = attach(df.withColumn(_VALUE, text), [_VALUE], codes)
    code = F.coalesce(F.col("__veil_code"), F.concat(F.lit(f"{prefix}_"), whole))
    return out.withColumn(column, F.when(F.col(_VALUE).isNotNull(), code)).select(
        *[ident(c) for c in df.columns]
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of value-label pairs as a table ``value``, ``label``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("value", "label"))


def dictionary(spark: SparkSession, pairs: dict | str) -> DataFrame:
    """Pairs written in the program, or as JSON text, as a dictionary table."""
    pairs = json.loads(pairs) if isinstance(pairs, str) else pairs
    return local_table(
        spark, value=pa.array(list(pairs), pa.string()), label=pa.array(list(pairs.values()), pa.string())
    )


def _unique(table: DataFrame, column: str) -> None:
    if table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count():
        raise PolicyError("a value is listed twice")


def map_values(df: DataFrame, column: str, table: DataFrame, default: str | None = REDACTED) -> DataFrame:
    """Replace a column's values by their labels in ``table(value, label)``.

    Values that are not listed become ``default``; nulls stay null.
    """
    _unique(table, "value")
    text = canon(ident(column), df.schema[column].dataType)
    labels = table.select(F.col("value").alias(_VALUE), F.col("label").alias("__veil_label"))
    out = attach(df.withColumn(_VALUE, text), [_VALUE], labels)
    label = F.coalesce(F.col("__veil_label"), F.lit(default))
    return out.withColumn(column, F.when(F.col(_VALUE).isNotNull(), label)).select(
        *[ident(c) for c in df.columns]
    )


def generalize_category(
    df: DataFrame, column: str, hierarchy: DataFrame, levels: int = 1, default: str | None = REDACTED
) -> DataFrame:
    """Replace values by their ancestors in ``hierarchy(value, parent)``.

    A value without a parent that far up stays at its topmost ancestor.
    """
    if levels < 1:
        raise PolicyError("levels must be at least 1")
    _unique(hierarchy, "value")
    table = hierarchy.select("value", F.col("parent").alias("label"))
    for _ in range(levels - 1):
        up = hierarchy.select(F.col("value").alias("label"), F.col("parent").alias("__veil_up"))
        table = attach(table, ["label"], up).select(
            "value", F.coalesce("__veil_up", "label").alias("label")
        )
    return map_values(df, column, table, default)


def _links(hierarchy: DataFrame) -> DataFrame:
    """(value, parent) as text; a root may be listed without a parent or as its own."""
    texts = hierarchy.select(F.col("value").cast("string").alias("value"), F.col("parent").cast("string").alias("parent"))
    return texts.filter("value != parent")


def _ancestors(hierarchy: DataFrame) -> DataFrame:
    """``value``, ``root``, ``depth``: the topmost ancestor of each value that has a parent.

    Pointer doubling: each round joins the table with itself, so that a value that
    has seen 1, 2, 4, ... steps up sees twice as many.  A tree of depth d takes
    log2(d) rounds; a value that has not come to a root after as many rounds as
    the number of values allows is in a cycle.
    """
    _unique(hierarchy, "value")
    table = materialize(_links(hierarchy).select("value", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    size = table.count()
    for _ in range(size.bit_length() + 1):
        up = table.select(F.col("value").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        stepped = attach(table, ["root"], up)
        if stepped.filter("up IS NOT NULL").isEmpty():
            return table
        table = materialize(stepped.select(
            "value", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    raise PolicyError("the hierarchy has a cycle")


def generalize_to_root(
    df: DataFrame, column: str, hierarchy: DataFrame, depth: int = 0, default: str | None = REDACTED
) -> DataFrame:
    """Replace values by their ancestor ``depth`` steps below the root of ``hierarchy(value, parent)``, whatever their own depth.

    A value at that depth or above stays itself, the root too.  Values that the
    hierarchy does not have become ``default``; nulls stay null.  The tree may be
    uneven and as deep as it likes; a cycle is an error.
    """
    if depth < 0:
        raise PolicyError("depth must not be negative")
    table = _ancestors(hierarchy)
    # A value's own distance to the root says how many steps it has to go up.
    steps = table.select("value", F.greatest(F.col("depth") - depth, F.lit(0)).alias("left"))
    parents = _links(hierarchy).withColumnRenamed("parent", "up")
    roots = table.select(F.col("root").alias("value")).distinct().join(table.select("value"), "value", "left_anti")
    if depth == 0:
        labels = table.select("value", F.col("root").alias("label"))
    else:
        labels = _climbed(steps, parents)
    return map_values(df, column, labels.unionByName(roots.select("value", F.col("value").alias("label"))), default)


def _climbed(steps: DataFrame, parents: DataFrame) -> DataFrame:
    """``value``, ``label``: each value's ancestor ``left`` steps up, by the binary digits of the number of steps."""
    most = steps.agg(F.max("left").alias("most")).first()["most"] or 0
    table = steps.select("value", F.col("value").alias("label"), "left")
    jump, bit = parents.select(F.col("value").alias("label"), "up"), 0
    while most >> bit:
        moved = attach(table, ["label"], jump)
        taken = F.shiftright("left", bit) % 2 == 1
        table = materialize(moved.select("value", F.when(taken, F.col("up")).otherwise(F.col("label")).alias("label"), "left"))
        twice = jump.select(F.col("label").alias("first"), F.col("up").alias("label"))
        jump = materialize(attach(twice, ["label"], jump).filter("up IS NOT NULL").select(
            F.col("first").alias("label"), "up"))
        bit += 1
    return table.select("value", "label")
