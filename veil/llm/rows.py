"""What all operators share: names that cannot clash, whole texts, keys of documents, numpy in Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def order_key(doc_id: Column) -> Column:
    """Documents come in the order of their ids, those without an id last."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


def released(run: Callable) -> Callable:
    """``run`` on Arrow batches that gives its memory back to the system when it ends.

    Python workers serve one task after another; what a task freed but the worker
    kept would stand beside the memory of all later stages.
    """
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def mapped(df: DataFrame, inputs: list[Column], run: Callable, added: dict[str, str]) -> DataFrame:
    """All rows with further columns that ``run`` computes in Arrow batches.

    ``run`` takes batches of the columns followed by ``inputs`` and yields batches
    of the columns followed by the new ones.  On the way columns only have
    numbers, so no name can clash or be misread.
    """
    columns = df.columns
    source = df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)],
                       *[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    kept = source.select(*[f"c{i}" for i in range(len(columns))])
    schema = T.StructType([*kept.schema.fields,
                           *(T.StructField(f"a{i}", T.DataType.fromDDL(k)) for i, k in enumerate(added.values()))])
    names = schema.names

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return source.mapInArrow(released(renamed), schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)],
        *[F.col(f"a{i}").alias(n) for i, n in enumerate(added)])


def extended(batch: pa.RecordBatch, inputs: int, made: list[pa.Array]) -> pa.RecordBatch:
    """A batch with its last ``inputs`` columns replaced."""
    kept = batch.columns[:batch.num_columns - inputs]
    return pa.RecordBatch.from_arrays([*kept, *made], names=[str(i) for i in range(len(kept) + len(made))])


def hash64(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"))


class Words(dict):
    """A word's 64-bit hash, kept for words seen lately; the memory it takes is bounded by ``most`` words."""

    def __init__(self, of: Callable[[str], int] = hash64, most: int = 500_000):
        super().__init__()
        self._of, self._most = of, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self._most:
            self.clear()
        value = self[word] = self._of(word)
        return value

    def array(self, words: list[str], dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=dtype, count=len(words))


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of the given lengths over one array of values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def mixed(h: np.ndarray) -> np.ndarray:
    """All bits of a 64-bit hash depend on all bits of the input."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours in an array of hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k:k + n]
    return mixed(out)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start:start + length]``, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    before = np.cumsum(lengths) - lengths
    at = np.repeat((starts - before).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def discard(stored: DataFrame) -> None:
    """Delete a table that ``materialize`` stored and that nothing reads any more."""
    files = stored.inputFiles()
    if files:
        spark = stored.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
