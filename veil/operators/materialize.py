"""Cutting lineage by a table written to the cluster's shared folder.

Executors may be lost at any time; a stored table is read again, where a cached
one would be computed again and could come out in another order.  Parquet keeps
it compact and lets later plans read only the columns and rows they need.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_STORED: ContextVar[list[str] | None] = ContextVar("veil_stored", default=None)


def scratch_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster the folder has to be shared, so there it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="veil-")
    return _LOCAL[sc.applicationId]


def scratch_path(spark: SparkSession) -> str:
    """A path of its own below the scratch folder; nothing is there yet."""
    return f"{scratch_folder(spark)}/veil-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and store; later plans read the stored rows."""
    path = scratch_path(df.sparkSession)
    stored = _STORED.get()
    if stored is not None:
        stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables stored within the block at its end.

    Results that build on them have to be written before.
    """
    stored: list[str] = []
    token = _STORED.set(stored)
    try:
        yield
    finally:
        _STORED.reset(token)
        for path in stored:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
