"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring tokens; the positions it ignores may be
substituted.  Every place of the test items and of the documents is hashed under
each mask.  The hashes of the items, folded into a bit table of fixed size, go to
all tasks; a document keeps the places whose bit is set, together with the tokens
around them.  Those few places are joined with the items' hashes, and each
meeting of a document with an item is verified on the tokens: the longest
stretch of the alignment with a share of substitutions that is allowed.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veil.llm.rows import Words, col, digest, fresh, mixed, released, whole_text
from veil.operators.materialize import materialize

#: 1: the token counts, 0: it may differ.  However a fifth of the tokens of an overlap is substituted, one of them fits
#: at some place: a test enumerates 10 to 25 tokens, and of a longer overlap some part of 13 to 25 keeps to the share.
MASKS = ("1101111", "1100010111", "11111001", "1110001011", "10110111", "111111")
#: Tokens that an overlap needs, or the whole item if that is shorter; and the share of them that may differ.
LEAST_TOKENS, SUBSTITUTED = 13, 0.2
#: Cells of the bit table, of which each hash has two; with very many test hashes it passes more places on to the join.
CELL_BITS = 24
CELLS = 2**CELL_BITS
#: Tokens of a region that are kept on each side of a place.
AROUND = 64

_WORD = re.compile(r"\w+")


class Tokens:
    def __init__(self):
        self._words = Words()

    def of(self, text: str) -> np.ndarray:
        return self._words.array(_WORD.findall(text.lower()))


def seeds(tokens: np.ndarray, masks=MASKS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the hashes of all places and the places."""
    out = []
    for n, mask in enumerate(masks):
        size = len(tokens) - len(mask) + 1
        if size > 0:
            h = np.full(size, np.uint64(n + 1))
            for k, use in enumerate(mask):
                if use == "1":
                    h *= np.uint64(0xD6E8FEB86659FD93)
                    h += tokens[k:k + size]
            out.append((mixed(h), np.arange(size)))
    return out


def short_masks(size: int, substituted: float) -> list[str]:
    """Masks over a whole item that is shorter than a mask: all places of the tokens that may differ."""
    zeros = min(int(substituted * size + 1e-9), max(0, size - 2))
    return ["".join("0" if k in out else "1" for k in range(size))
            for out in combinations(range(1, size - 1), zeros)]


def overlap(a: np.ndarray, b: np.ndarray, least: int, substituted: float) -> int:
    """Tokens of the longest stretch that begins and ends with equal tokens and keeps to the share; 0 if too short."""
    equal = a == b
    places = np.flatnonzero(equal)
    if not len(places):
        return 0
    # cost of a stretch from place i to place j: (differing) - share * (length) <= 0
    ahead = np.concatenate([[0], np.cumsum(~equal)])
    cost_start = ahead[places] - substituted * places
    cost_end = ahead[places + 1] - substituted * (places + 1)
    lowest = np.minimum.accumulate(cost_end[::-1])[::-1]
    best, j = 0, 0
    # Both bounds only move forward: the longest stretch is found in one pass.
    highest = np.maximum.accumulate(cost_start)
    for i in range(len(places)):
        if i and cost_start[i] <= highest[i - 1]:
            continue
        j = max(j, i)
        while j + 1 < len(places) and lowest[j + 1] <= cost_start[i] + 1e-9:
            j += 1
        if cost_end[j] <= cost_start[i] + 1e-9:
            best = max(best, int(places[j] - places[i] + 1))
    return best if best >= least else 0


def _item_seeds(items: DataFrame, masks, substituted: float) -> DataFrame:
    """(hash, item, place) of all places of the items (item, text), and the items' tokens by the way."""

    def run(batches):
        make = Tokens()
        for batch in batches:
            hashes, ids, places = [], [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = make.of(text)
                found = seeds(tokens, masks)
                if 0 < len(tokens) < max(map(len, masks)):
                    found = seeds(tokens, short_masks(len(tokens), substituted))
                for h, at in found:
                    hashes.append(h.view(np.int64))
                    places.append(at)
                    ids += [item] * len(h)
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes)), pa.array(ids, pa.binary()),
                     pa.array(np.concatenate(places).astype(np.int32))], ["hash", "item", "place"])

    return items.mapInArrow(run, "hash bigint, item binary, place int")


def _item_tokens(items: DataFrame) -> DataFrame:
    def run(batches):
        make = Tokens()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([make.of(t).view(np.int64) for t in batch.column(1).to_pylist()],
                                           pa.list_(pa.int64()))], ["item", "tokens"])

    return items.mapInArrow(run, "item binary, tokens array<bigint>")


def _regions(docs: DataFrame, table, short: list[list[str]], masks) -> DataFrame:
    """The parts of documents (text_id, text) around places whose hash may be an item's.

    A region has the tokens from ``AROUND`` before its first place to ``AROUND``
    behind its last and lists (hash, place in the region).
    """
    longest = max(map(len, masks))

    def run(batches):
        make, bits = Tokens(), table.value
        for batch in batches:
            ids, tokens_of, hashes_of, places_of = [], [], [], []
            for text_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = make.of(text)
                found = []
                whole = [found for same in short for found in seeds(tokens, same)]
                for h, at in seeds(tokens, masks) + whole:
                    hit = np.flatnonzero(bits[(h & np.uint64(CELLS - 1)).astype(np.int64)])
                    high = (h[hit] >> np.uint64(CELL_BITS)) & np.uint64(CELLS - 1)
                    hit = hit[bits[high.astype(np.int64)]]
                    if len(hit):
                        found.append((h[hit], at[hit]))
                if not found:
                    continue
                h, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                cuts = np.flatnonzero(np.diff(at) > AROUND) + 1
                for hs, ps in zip(np.split(h, cuts), np.split(at, cuts), strict=True):
                    start = max(0, int(ps[0]) - AROUND)
                    ids.append(text_id)
                    tokens_of.append(tokens[start:int(ps[-1]) + longest + AROUND].view(np.int64))
                    hashes_of.append(hs.view(np.int64))
                    places_of.append((ps - start).astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.binary()), pa.array(tokens_of, pa.list_(pa.int64())),
                     pa.array(hashes_of, pa.list_(pa.int64())), pa.array(places_of, pa.list_(pa.int32()))],
                    ["text_id", "tokens", "hashes", "places"])

    return docs.mapInArrow(released(run), "text_id binary, tokens array<bigint>, hashes array<bigint>, places array<int>")


def _verified(met: DataFrame, least: int, substituted: float) -> DataFrame:
    """(text_id, item, tokens): the overlap of a region with an item along one alignment."""

    def run(batches):
        for batch in batches:
            ids, items, sizes = [], [], []
            for text_id, item, shift, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.array(own, dtype=np.int64), np.array(other, dtype=np.int64)
                first, last = max(0, shift), min(len(a), shift + len(b))
                size = overlap(a[first:last], b[first - shift:last - shift], min(least, len(b)), substituted)
                if size:
                    ids.append(text_id)
                    items.append(item)
                    sizes.append(size)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(items, pa.binary()),
                                                  pa.array(sizes, pa.int32())], ["text_id", "item", "size"])

    return met.select("text_id", "item", "shift", "tokens", "item_tokens").mapInArrow(
        released(run), "text_id binary, item binary, size int")


def contaminated_texts(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
                       masks=MASKS, least: int = LEAST_TOKENS, substituted: float = SUBSTITUTED) -> DataFrame:
    """(text_id, n_items, longest) for each distinct text that overlaps an item; ``items`` may have any size."""
    spark = docs.sparkSession
    tests = items.select(digest(whole_text(item_text)).alias("item"), whole_text(item_text).alias("text")).distinct()
    hashed = materialize(_item_seeds(tests, masks, substituted))
    tokens = materialize(_item_tokens(tests))
    # The table has a fixed number of cells, whatever the number of items.
    both = F.array(F.col("hash"), F.shiftrightunsigned("hash", CELL_BITS))
    cells = hashed.select(F.explode(both).alias("hash")).select(
        F.pmod("hash", F.lit(CELLS)).cast("int").alias("cell")).distinct().toPandas()["cell"]
    bits = np.zeros(CELLS, dtype=bool)
    bits[cells.to_numpy(dtype=np.int64)] = True
    shortest = max(map(len, masks))
    short = [r["n"] for r in tokens.select(F.size("tokens").alias("n")).filter(
        (F.col("n") > 0) & (F.col("n") < shortest)).distinct().collect()]
    source = docs.select(digest(whole_text(text)).alias("text_id"), whole_text(text).alias("text"))
    regions = materialize(_regions(source, spark.sparkContext.broadcast(bits), [short_masks(n, substituted) for n in sorted(short)], masks).withColumn(
        "region", F.xxhash64("text_id", F.element_at("places", 1), F.size("tokens"), "tokens")).dropDuplicates(
        ["text_id", "region"]))
    places = regions.select("text_id", "region", F.explode(F.arrays_zip("hashes", "places")).alias("z")).select(
        "text_id", "region", F.col("z.hashes").alias("hash"), F.col("z.places").alias("at"))
    met = places.join(hashed, "hash").select("text_id", "region", "item", (F.col("at") - F.col("place")).alias("shift"))
    met = met.distinct().join(regions.select("text_id", "region", "tokens"), ["text_id", "region"]).join(
        tokens.select("item", F.col("tokens").alias("item_tokens")), "item")
    return _verified(met, least, substituted).groupBy("text_id").agg(
        F.count_distinct("item").cast("int").alias("n_items"), F.max("size").alias("longest"))


def mark_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
                      **options) -> DataFrame:
    """All rows with ``n_items``, the test items they overlap, and ``longest``, the tokens of the longest overlap.

    An overlap has thirteen tokens, or the whole item if that is shorter, of
    which a fifth may be substituted; words are compared in lower case without
    punctuation.  Null and empty texts and items overlap nothing; equal texts get
    equal results; without items nothing is found; names that are taken get
    underscores.
    """
    n_items, longest, at = fresh(docs, "n_items", "longest", "at")
    found = contaminated_texts(docs, items, text, item_text, **options).select(
        F.col("text_id").alias(at), F.col("n_items").alias(n_items), F.col("longest").alias(longest))
    return docs.withColumn(at, digest(whole_text(text))).join(found, at, "left").select(
        *[col(c) for c in docs.columns], F.coalesce(n_items, F.lit(0)).alias(n_items),
        F.coalesce(longest, F.lit(0)).alias(longest))
