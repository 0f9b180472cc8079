"""Bytes of repeated 200-byte strings, found by sorting suffixes only as deep as that.

Suffixes are compared by most-significant-digit passes.  A pass splits suffixes by
the next stretch of bytes (by its hash) and drops those that are alone in their
group; what is left after the last pass, at 200 bytes, are exactly the strings
that start at two places or more.

To sort fewer suffixes, the strings of 200 bytes hang on anchors: the place in it
whose 50 bytes have the least hash, the first of equals.  Equal strings have the
same anchor, and neighbours mostly share one, so about one suffix in 75 takes part.

1. The 50 bytes at an anchor (its core): anchors with a core of their own drop out.
2. The longest stretch that belongs to the anchor, from the first of its strings to
   the end of the last: if it repeats, so do all of its strings.
3. The strings of the others in blocks of 16 neighbours: the 185 bytes that a block
   has in common.  Blocks whose common bytes do not repeat drop out.
4. The strings of the remaining blocks: the 15 bytes that each has besides the common
   ones, some before and some behind them.  Blocks that are equal with all their
   neighbours count once, with their number.

Passes hand on what they found as bit tables of a fixed size, which may let too much
through to the next pass but never too little; the last word is always an exact
join.  Groups are only counted, with partial sums before the shuffle, so a string
that fills a third of the corpus is a number in each task, not a group in one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from veil.llm.rows import col, digest, discard, extended, fresh, mixed, ragged, whole_text
from veil.operators.materialize import materialize

WINDOW, CORE, BLOCK = 200, 50, 16
#: Cells of a bit table, and of the part of it that one row carries.
CELLS, PART = 2**26, 2**15

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Hasher:
    """Hashes of any stretch of a text in constant time, from sums over its beginnings."""

    def __init__(self):
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            up, down = np.full(2 * n, _BASE), np.full(2 * n, _INVERSE)
            up[0] = down[0] = 1
            self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = (ends - starts).astype(np.uint64)
        return mixed(mixed((sums[ends] - sums[starts]) * self._down[starts]) ^ (sizes * np.uint64(0xD6E8FEB86659FD93)))


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` neighbours."""
    out, size = values, 1
    while size * 2 <= reach:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == reach else np.minimum(out[:len(out) - (reach - size)], out[reach - size:])


def anchors(sums: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text, the first string of each, and the hashes of their cores.

    An anchor's strings go up to the one before the next anchor's first.
    """
    strings = len(sums) - WINDOW
    if strings <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty.astype(np.uint64)
    reach = WINDOW - CORE + 1
    at = np.arange(strings + reach - 1)
    cores = hasher.of(sums, at, at + CORE)
    low = _least(cores, reach)
    changes = np.append(np.flatnonzero(low[1:] != low[:-1]) + 1, strings).tolist()
    places, firsts = [], []
    start, n = 0, 0
    while start < strings:
        while changes[n] <= start:
            n += 1
        place = start + int(cores[start:start + reach].argmin())
        places.append(place)
        firsts.append(start)
        start = min(place + 1, changes[n])
    places = np.array(places)
    return places, np.array(firsts), cores[places]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return ragged(np.concatenate(values), np.array([len(v) for v in values]), kind)


_ANCHORS = "text_id binary, size int, places array<int>, firsts array<int>, cores array<bigint>, wholes array<bigint>"


def _anchored(docs: DataFrame) -> DataFrame:
    """A row for each document (text_id, text) that has a string: its anchors."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text_id, text = (c[i].as_py() for c in batch.columns)
                sums = hasher.sums(_bytes(text))
                places, firsts, cores = anchors(sums, hasher)
                if len(places):
                    ends = np.append(firsts[1:], len(sums) - WINDOW) - 1 + WINDOW
                    rows.append((text_id, len(sums) - 1, places, firsts, _signed(cores),
                                 _signed(hasher.of(sums, firsts, ends))))
            if rows:
                ids, sizes, *lists = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()),
                     *(_lists(v, k) for v, k in zip(lists, (pa.int32(), pa.int32(), pa.int64(), pa.int64()),
                                                    strict=True))],
                    ["text_id", "size", "places", "firsts", "cores", "wholes"])

    return docs.mapInArrow(run, _ANCHORS)


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur twice or more; rows have a number n of occurrences."""
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 1").select(*keys)


def _bit_table(keys: DataFrame, key: str):
    """The keys' last bits as a broadcast table of CELLS bits, whatever their number."""
    cell = F.col(key).bitwiseAND(F.lit(CELLS - 1))
    cells = keys.select((cell / PART).cast("int").alias("part"), (cell % PART).cast("int").alias("at")).distinct()

    def pack(rows):
        import pandas as pd

        bits = np.zeros(PART, dtype=bool)
        bits[rows["at"].to_numpy()] = True
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    table = np.zeros((CELLS // PART, PART // 8), dtype=np.uint8)
    for row in cells.groupBy("part").applyInPandas(pack, "part int, bits binary").toPandas().itertuples():
        table[row.part] = np.frombuffer(row.bits, dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.ravel())


def _in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys.view(np.uint64) & np.uint64(CELLS - 1)
    return (table[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) \
        & 1 == 1


def _per_batch_counts(rows: DataFrame, column: str) -> DataFrame:
    """(key, n) of a list column, counted within batches first."""

    def run(batches):
        for batch in batches:
            keys, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return rows.select(column).mapInArrow(run, "key bigint, n bigint")


def _surviving(anchored: DataFrame, table) -> DataFrame:
    """(text_id, place, first, last, core, whole) of anchors whose core may repeat, in lists by document."""

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                size = batch.column(1)[i].as_py()
                places, firsts, cores, wholes = (
                    batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
                keep = _in_table(table.value, cores)
                if keep.any():
                    lasts = np.append(firsts[1:], size - WINDOW + 1) - 1
                    rows.append((batch.column(0)[i].as_py(),
                                 *(v[keep] for v in (places, firsts, lasts, cores, wholes))))
            if rows:
                ids, *lists = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.binary()), *(_lists(v, k) for v, k in zip(lists, kinds, strict=True))],
                    ["text_id", "place", "first", "last", "core", "whole"])

    return anchored.mapInArrow(run, "text_id binary, place array<int>, first array<int>, last array<int>, "
                                    "core array<bigint>, whole array<bigint>")


def _cut(places, firsts, lasts, cores) -> tuple[np.ndarray, ...]:
    """Blocks of the strings of anchors: core, where the common bytes start and end, least and most bytes before them.

    Blocks are cut by the distance to the anchor, so they are the same wherever
    the strings stand.  A string of a block starts some bytes before the common ones.
    """
    places, firsts, lasts = (np.array(x, dtype=np.int64) for x in (places, firsts, lasts))
    low, high = (places - lasts) // BLOCK, (places - firsts) // BLOCK
    n = high - low + 1
    number = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    base = np.repeat(places, n) - number * BLOCK
    least = np.maximum(0, base - np.repeat(lasts, n))
    most = np.minimum(BLOCK - 1, base - np.repeat(firsts, n))
    return np.repeat(np.array(cores, dtype=np.int64), n), base, base - BLOCK + 1 + WINDOW, least, most


def _block_hashes(open_: DataFrame) -> DataFrame:
    """(core, key, n) of the blocks of open anchors (text, place, first, last, core), counted within batches first."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            found = []
            for text, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                core, start, end, _, _ = _cut(*lists)
                found.append(np.column_stack([core, _signed(hasher.of(hasher.sums(_bytes(text)), start, end))]))
            keys, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n, pa.int64())],
                                             ["core", "key", "n"])

    return open_.select("text", "place", "first", "last", "core").mapInArrow(run, "core bigint, key bigint, n bigint")


def _live_blocks(open_: DataFrame, table) -> DataFrame:
    """Blocks whose common bytes may repeat: (text_id, base, core, key, least, left, right).

    ``left`` are the bytes before the common ones that the block's strings reach, ``right`` those behind.
    """

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            rows = []
            for text_id, text, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                core, start, end, least, most = _cut(*lists)
                keys = _signed(hasher.of(hasher.sums(np.frombuffer(data, dtype=np.uint8)), start, end))
                live = np.flatnonzero(_in_table(table.value, keys))
                for c, k, s, e, a, b in zip(*(v[live].tolist() for v in (core, keys, start, end, least, most)),
                                            strict=True):
                    rows.append((text_id, s, c, k, a, data[s - b:s], data[e:e + BLOCK - 1 - a]))
            if rows:
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["text_id", "base", "core", "key", "least", "left", "right"])

    return open_.select("text_id", "text", "place", "first", "last", "core").mapInArrow(
        run, "text_id binary, base int, core bigint, key bigint, least int, left binary, right binary")


def _repeated_strings(live: DataFrame) -> DataFrame:
    """(text_id, runs) of the strings of blocks that occur twice or more."""
    same = ["core", "key", "least", "left", "right"]
    kinds = materialize(live.groupBy(*same).agg(F.count("*").alias("n")))
    # A kind that is alone with its common bytes has nothing to compare: its strings repeat if it does.
    several = kinds.groupBy("core", "key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("core", "key")
    befores = F.sequence("least", F.octet_length("left"))
    around = F.concat(F.substr("left", F.octet_length("left") - F.col("before") + 1, F.col("before")),
                      F.substr("right", F.lit(1), F.lit(BLOCK - 1) - F.col("before")))
    strings = kinds.join(several, ["core", "key"], "left_semi").select(
        *same, "n", F.explode(befores).alias("before")).withColumn("around", around)
    twice = _counted(strings, "core", "key", "before", "around")
    found = strings.filter("n = 1").join(twice, ["core", "key", "before", "around"], "left_semi").groupBy(*same).agg(
        F.array_sort(F.collect_list("before")).alias("found"))
    found = found.unionByName(kinds.filter("n > 1").select(*same, befores.alias("found")))
    joined = live.join(found, same)
    first, last = F.element_at("found", 1), F.element_at("found", -1)
    runs = F.when(F.size("found") == last - first + 1, F.array(_run(F.col("base") - last, F.col("base") - first))) \
        .otherwise(F.transform("found", lambda b: _run(F.col("base") - b, F.col("base") - b)))
    return joined.select("text_id", runs.alias("runs"))


def _run(first, last):
    """The bytes of the strings that start from ``first`` to ``last``."""
    return F.struct(first.cast("int").alias("start"), (last + WINDOW).cast("int").alias("end"))


def repeated_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_id, runs) for each distinct text with a string that starts at two places or more.

    Runs (start, end) are bytes of such strings; they may overlap and come in any order.
    """
    source = docs.select(digest(whole_text(text)).alias("text_id"), whole_text(text).alias("text"))
    anchored = materialize(_anchored(source.filter(F.octet_length("text") >= WINDOW)))
    cores = _bit_table(_counted(_per_batch_counts(anchored, "cores"), "key"), "key")
    # Equal texts are one row with their number from here on.
    distinct = _surviving(anchored, cores).groupBy("text_id").agg(
        F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("place", "first", "last", "core", "whole")])
    rows = materialize(distinct.select("text_id", "n", F.explode(
        F.arrays_zip("place", "first", "last", "core", "whole")).alias("a")).select("text_id", "n", "a.*"))
    discard(anchored)
    found = _counted(rows, "core", "whole").withColumn("found", F.lit(True))
    judged = materialize(rows.join(found, ["core", "whole"], "left"))
    discard(rows)
    runs = judged.filter("found").select("text_id", F.array(_run(F.col("first"), F.col("last"))).alias("runs"))

    # A string of an open anchor may equal one of an anchor that is settled: of each
    # settled stretch with the same core one takes part in the next passes as well.
    unsettled = judged.filter("found IS NULL")
    settled = judged.filter("found").join(unsettled.select("core").distinct(), "core", "left_semi").groupBy(
        "core", "whole").agg(F.min(F.struct("text_id", "place", "first", "last")).alias("a"))
    taking_part = unsettled.select("text_id", "place", "first", "last", "core").unionByName(
        settled.select("a.*", "core"))
    lists = taking_part.groupBy("text_id").agg(F.collect_list(F.struct("place", "first", "last", "core")).alias("a"))
    lists = materialize(lists.select("text_id", *[F.col("a")[c].alias(c) for c in ("place", "first", "last", "core")]))
    open_ = materialize(_with_text(source, lists))
    discard(lists)
    blocks = _bit_table(_counted(_block_hashes(open_), "core", "key"), "key")
    live = materialize(_live_blocks(open_, blocks))
    discard(open_)
    return runs.unionByName(_repeated_strings(live)).groupBy("text_id").agg(
        F.flatten(F.collect_list("runs")).alias("runs"))


def _id_table(ids: DataFrame):
    """A bit table of text ids."""
    return _bit_table(ids.select(F.xxhash64("text_id").alias("key")), "key")


def _split_by_table(source: DataFrame, table, inside: bool) -> DataFrame:
    """The rows whose text_id may be in the table, or the others."""
    names = source.columns

    def run(batches):
        for batch in batches:
            keep = _in_table(table.value, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)) == inside
            if keep.any():
                yield batch.select(names).filter(pa.array(keep))

    keyed = source.withColumn("table_key", F.xxhash64("text_id"))
    return keyed.mapInArrow(run, source.schema)


def _with_text(source: DataFrame, lists: DataFrame) -> DataFrame:
    """Each distinct text of ``source`` whose text_id is in ``lists``, joined; other texts are mostly not shuffled."""
    some = _split_by_table(source, _id_table(lists.select("text_id")), inside=True)
    return some.groupBy("text_id").agg(F.any_value("text").alias("text")).join(lists, "text_id")


def remove_repeats(docs: DataFrame, text: str = "text", out: str = "kept") -> DataFrame:
    """All rows with the bytes that are left of their text, and how much went.

    Texts are UTF-8 bytes, a null text is an empty one.  A byte goes if it lies in
    a string of 200 bytes that starts at another place too, in the same text or in
    another row; rows with equal texts of 200 bytes or more lose everything.
    Shorter texts lose nothing.  New columns are ``out`` (binary), ``n_bytes``,
    ``n_removed`` and ``n_spans``, the removed runs; names that are taken get
    underscores.  An empty table stays empty.
    """
    names = dict(zip(fresh(docs, out, "n_bytes", "n_removed", "n_spans"), ("binary", "bigint", "bigint", "bigint"),
                     strict=True))
    found = materialize(repeated_runs(docs, text))
    table = _id_table(found.select("text_id"))
    # One column carries the row, so that no name can clash on the way.
    source = docs.select(digest(whole_text(text)).alias("text_id"), F.struct(*[col(c) for c in docs.columns]).alias("row"))
    joined = _split_by_table(source, table, inside=True).join(found, "text_id", "left")
    whole = F.coalesce(F.col("row")[text].cast("string"), F.lit("")).cast("binary")

    def unchanged(rows: DataFrame) -> DataFrame:
        made = [whole, F.octet_length(whole).cast("bigint"), *[F.lit(0).cast("bigint")] * 2]
        return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns],
                           *[m.alias(n) for m, n in zip(made, names, strict=True)])

    clean = unchanged(_split_by_table(source, table, inside=False)).unionByName(
        unchanged(joined.filter("runs IS NULL")))

    def cut(batches):
        for batch in batches:
            own, runs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            rest, sizes, gone, spans = [], [], [], []
            for i in range(batch.num_rows):
                data, pair = own[i].as_py(), runs[i].values
                edges = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edges, pair.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(edges, pair.field(1).to_numpy(zero_copy_only=False), -1)
                lost = np.cumsum(edges)[:-1] > 0
                rest.append(np.frombuffer(data, dtype=np.uint8)[~lost].tobytes())
                sizes.append(len(data))
                gone.append(int(lost.sum()))
                spans.append(int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()))
            yield extended(batch, 2, [pa.array(rest, pa.binary()),
                                      *(pa.array(v, pa.int64()) for v in (sizes, gone, spans))])

    found_rows = joined.filter("runs IS NOT NULL")
    made = {f"made{i}": k for i, k in enumerate(names.values())}
    dirty = found_rows.select("row", whole.alias("whole"), "runs").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays(b.columns, names=["row", *made]) for b in cut(batches)),
        T.StructType([source.schema["row"], *(T.StructField(m, T.DataType.fromDDL(k)) for m, k in made.items())]))
    return clean.unionByName(dirty.select(*[F.col("row")[c].alias(c) for c in docs.columns],
                                          *[F.col(m).alias(n) for m, n in zip(made, names, strict=True)]))
