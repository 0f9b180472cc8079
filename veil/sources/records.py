"""Records of CSV files, cut out of blocks that tasks read independently.

A line break ends a record unless a quoted value is open, and whether one is
open depends on all quotes before it in the file.  So the quotes of every block
are counted first; a running sum over the blocks, one short row each, tells
which blocks begin inside a value.  Knowing that, each task finds the records of
its blocks alone.  A record that goes on in later blocks leaves fragments, which
are put together by the block in which it began.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veil.operators.materialize import materialize

WHOLE, OPENED, CONTINUED = 0, 1, 2
_TASK_BYTES = 32 << 20  # blocks that are smaller are read several by one task
_TASKS_A_CORE = 4  # as long as every core has so many tasks
_COLUMNS = "record string, file bigint, start bigint, kind int, first boolean"


def _tasks(spark: SparkSession, path: str) -> int:
    """How many tasks read the files, at most: by their bytes, whatever the number of their blocks."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
    return max(_TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-size // _TASK_BYTES))


def _lines(spark: SparkSession, path: str, tasks: int) -> DataFrame:
    """(value, file, start): lines with the file and the block they stand in; within a block they come in order.

    A task reads its blocks one after another, each as if it were alone.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("start")).coalesce(tasks)


def _blocks(lines: DataFrame, quote: str, path: str) -> DataFrame:
    """(file, start, inside): whether a quoted value is open where the block begins."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    counted = materialize(lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes")))
    if not counted.groupBy("file").agg(F.sum("quotes").alias("quotes")).filter("quotes % 2 = 1").isEmpty():
        raise ValueError(f"a quoted value is not closed in {path}")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return materialize(counted.select("file", "start", inside.alias("inside")))


class _Block:
    """What is known of the block that is being read."""

    def __init__(self, key=None, inside: bool = False):
        self.key, self.inside = key, inside
        self.open: list[str] = []
        self.continued = inside
        self.first = True


def _cut(lines: DataFrame, quote: str, fragments: bool) -> DataFrame:
    """The whole records of all blocks, or the fragments of the others; ``first`` marks the first one of a file."""
    def run(batches):
        block = _Block()
        for batch in batches:
            made: list[tuple[pa.Array, tuple, int, int]] = []  # records, block, kind, number of first ones

            def emit(records, kind, block, made=made):
                first = block.key[1] == 0 and block.first and kind != CONTINUED
                if first and kind == WHOLE:
                    while len(records) and not records[0].as_py().strip():  # blank lines before the header
                        records = records.slice(1)
                    if not len(records):
                        return
                block.first = False
                if (kind != WHOLE) == fragments:
                    made.append((records, block.key, kind, int(first)))

            def end(block, emit=emit):
                if block.open:
                    emit(pa.array(["\n".join(block.open)]), CONTINUED if block.continued else OPENED, block)

            values = batch.column(0)
            keys = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = (int(keys[0, a]), int(keys[1, a]))
                if key != block.key:
                    end(block)
                    inside = batch.column(3)[int(a)].as_py()
                    if inside is None:
                        raise ValueError("the files or their blocks changed while they were read")
                    block = _Block(key, inside)
                run_values = values.slice(a, b - a)
                quotes = pc.count_substring(run_values, quote).to_numpy()
                after = (int(block.inside) + np.cumsum(quotes)) % 2
                starts = np.flatnonzero((after + quotes) % 2 == 0)
                block.inside = bool(after[-1])
                if not len(starts):
                    block.open += run_values.to_pylist()
                    continue
                if starts[0]:
                    block.open += run_values.slice(0, int(starts[0])).to_pylist()
                if block.open:
                    emit(pa.array([_ended("\n".join(block.open))]), CONTINUED if block.continued else WHOLE, block)
                    block.open = []
                block.continued = False
                offsets = pa.array(np.append(starts, len(run_values)).astype(np.int32))
                records = pc.binary_join(pa.ListArray.from_arrays(offsets, run_values), "\n")
                if block.inside:
                    block.open = [records[-1].as_py()]
                    records = records.slice(0, len(records) - 1)
                if len(records):
                    emit(pc.replace_substring_regex(records, "\r$", ""), WHOLE, block)
            yield _batch(made)
        if block.open:
            made = []
            emit(pa.array(["\n".join(block.open)]), CONTINUED if block.continued else OPENED, block, made)
            yield _batch(made)

    return lines.mapInArrow(run, _COLUMNS)


def _ended(record: str) -> str:
    """Without the carriage return of the line end; quoted values end with a quote, so it is not theirs."""
    return record.removesuffix("\r")


def _batch(made) -> pa.RecordBatch:
    sizes = [len(records) for records, *_ in made]
    total = sum(sizes)
    first = np.zeros(total, dtype=bool)
    at = 0
    for size, (_, _, _, firsts) in zip(sizes, made, strict=True):
        first[at:at + firsts] = True
        at += size

    def column(values, kind):
        return pa.array(np.repeat(np.array(values, dtype=np.int64), sizes), pa.int64()).cast(kind)

    records = pa.concat_arrays([m[0].cast(pa.string()) for m in made]) if made else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays(
        [records, column([m[1][0] for m in made], pa.int64()), column([m[1][1] for m in made], pa.int64()),
         column([m[2] for m in made], pa.int32()), pa.array(first)], ["record", "file", "start", "kind", "first"])


def csv_records(spark: SparkSession, path: str, quote: str = '"', header: bool = True) -> DataFrame | None:
    """The records of all files at ``path``, one text each, without the headers; None if the files lie in partitions.

    The files are read twice, and a third time if a record crosses blocks.
    Lines end with a line feed, with or without a carriage return before it.
    """
    if spark.read.text(path).columns != ["value"]:
        return None
    tasks = _tasks(spark, path)
    lines = _lines(spark, path, tasks)
    blocks = _blocks(lines, quote, path)
    placed = lines.join(F.broadcast(blocks), ["file", "start"], "left").select("value", "file", "start", "inside")
    records = _cut(placed, quote, fragments=False).select("record", "first")
    if not blocks.filter("inside").isEmpty():
        fragments = materialize(_cut(placed, quote, fragments=True)).coalesce(tasks)
        # Within a block the rest of the record before comes first.
        order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
        began = F.last(F.when(F.col("kind") == OPENED, F.col("start")), ignorenulls=True).over(order)
        joined = fragments.withColumn("began", began).groupBy("file", "began").agg(
            F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"), F.max("first").alias("first"))
        whole = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
        records = records.unionByName(joined.select(whole.alias("record"), "first"))
    return records.filter("NOT first").select("record") if header else records.select("record")
