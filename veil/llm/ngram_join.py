"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Each text becomes the set of hashes of its five-word shingles; equal sets are
   one class from here on.  Band hashes come from a MinHash signature whose bands
   and rows follow from the similarity and the recall wanted.
2. Classes are shuffled on band hashes.  A bucket is known by its hub, its
   smallest class; a class takes part in the cells of all its hubs, so classes
   that share a bucket share a cell.  A cell's size does not depend on the number
   of its buckets, and no pairs are written anywhere.
3. Cells with much text or many members are dealt into chunks, and each pair of chunks is a block
   of its own.  A block counts, in numpy, the shingles that its members share,
   keeps the pairs that reach the similarity, and returns one row for a member:
   how many documents it is linked to, and the root of its group in the block.  A
   link that shows in several cells counts in the one with the smallest hub.
4. Groups of blocks are joined to connected components.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veil.llm.components import components
from veil.llm.rows import Words, col, digest, fresh, mixed, order_key, released, whole_text, windows
from veil.operators.materialize import materialize

SIZE, SIMILARITY, RECALL = 5, 0.8, 0.999
#: A signature has no more numbers than this.
MOST_HASHES = 144
#: Characters of text in a chunk of a cell; a block holds two chunks.
CHUNK_CHARS = 2_000_000
#: Members of a chunk, about; the memory of a block grows with the square of its members.
CHUNK_MEMBERS = 2_000
_WORD = re.compile(r"\w+")


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL,
                   most: int = MOST_HASHES) -> tuple[int, int]:
    """The longest bands that still find a pair of the given similarity with the recall wanted."""
    best = None
    for rows in range(1, most + 1):
        hit = similarity ** rows
        if hit >= 1:
            return 1, most
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError(f"no {most} hashes reach a recall of {recall} at {similarity}")
    return best


class Shingles:
    """Sets of n-grams of words in lower case, without punctuation."""

    def __init__(self, size: int = SIZE):
        self._size, self._words = size, Words()

    def of(self, text: str) -> np.ndarray:
        """Distinct hashes in order.  A shorter text is one n-gram; without words the whole text is."""
        words = _WORD.findall(text.lower())
        if not words:
            return self._words.array(["\n" + text])
        hashes = self._words.array(words)
        return np.unique(windows(hashes, min(self._size, len(words))))


class Signer:
    """Band hashes of sets."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        self._bands, self._rows = bands, rows
        self._factor = draw.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._plus = draw.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64)
        self._weights = draw.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self._bands * self._rows, np.uint64(2**64 - 1))
        for start in range(0, len(shingles), 2048):
            part = shingles[None, start:start + 2048] * self._factor
            part += self._plus
            part ^= part >> np.uint64(32)
            np.minimum(least, part.min(axis=1), out=least)
        bands = (least.reshape(self._bands, self._rows) * self._weights).sum(axis=1, dtype=np.uint64)
        return mixed(bands + np.arange(self._bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_id, set_id, bands) of documents (doc_id, text_id, text)."""

    def run(batches):
        make, sign = Shingles(size), Signer(bands, rows)
        for batch in batches:
            ids, signs = [], []
            for text in batch.column(2).to_pylist():
                found = make.of(text)
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signs.append(sign.of(found))
            flat = np.concatenate(signs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)),
                                          pa.array(flat))],
                ["doc_id", "text_id", "set_id", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(released(run), f"doc_id {kind}, text_id binary, set_id binary, bands array<bigint>")


def _shared(sets: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """How many elements each two sets share."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(place, minlength=len(values))
    number = np.cumsum(often > 1) - 1
    keep = often[place] > 1
    owner, place = owner[keep], number[place[keep]]
    out = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    last = int(place[-1]) + 1 if len(place) else 0
    for start in range(0, last, slab):
        a, b = np.searchsorted(place, [start, start + slab])
        has = np.zeros((m, min(slab, last - start)), dtype=np.float32)
        has[owner[a:b], place[a:b] - start] = 1
        out += has @ has.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's group."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block(hub: bytes, left: list, right: list | None, similarity: float) -> list[tuple[bytes, int, bytes]]:
    """Links of the members of a block: (set, documents it is linked to, root of its group).

    A member is (set_id, documents in the class, hubs, shingles).  With two
    chunks only pairs between them count; the pairs inside a chunk are those of
    the block of that chunk alone.
    """
    members = left + (right or [])
    if len(members) < 2 or right is not None and (not left or not right):
        return []
    shared = _shared([m[3] for m in members])
    sizes = np.array([len(m[3]) for m in members], dtype=np.float64)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= similarity * union - 1e-9
    np.fill_diagonal(linked, False)
    if right is not None:
        linked[:len(left), :len(left)] = False
        linked[len(left):, len(left):] = False
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return []
    linked, members = linked[np.ix_(some, some)], [members[i] for i in some]
    roots = _roots(linked)
    # Pairs that meet in a cell with a smaller hub are counted there.
    smaller: dict[bytes, list[int]] = {}
    for i, m in enumerate(members):
        for h in m[2]:
            if h < hub:
                smaller.setdefault(h, []).append(i)
    for where in smaller.values():
        if len(where) > 1:
            linked[np.ix_(where, where)] = False
    links = linked @ np.array([m[1] for m in members], dtype=np.float64)
    return [(m[0], int(n), members[r][0]) for m, n, r in zip(members, links, roots, strict=True)]


def _verified(cells: DataFrame, similarity: float, size: int) -> DataFrame:
    """Blocks of (hub, i, j, second, set_id, docs, hubs, text) to (set_id, links, root)."""

    def run(batches):
        make = Shingles(size)
        key, parts = None, ({}, {})

        def flush() -> list:
            if key is None:
                return []
            hub, i, j = key
            # A document that is there twice brings its set twice; the dictionary keeps one.
            members = [[(s, n, h, make.of(t)) for s, (n, h, t) in p.items()] for p in parts]
            return _block(hub, members[0], None if i == j else members[1], similarity)

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary())], ["set_id", "links", "root"])

        for batch in batches:
            out = []
            for hub, i, j, second, set_id, n, hubs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (hub, i, j) != key:
                    out += flush()
                    key, parts = (hub, i, j), ({}, {})
                parts[second][set_id] = (n, hubs, text)
            if out:
                yield made(out)
        last = flush()
        if last:
            yield made(last)

    ordered = cells.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return ordered.select("hub", "i", "j", "second", "set_id", "docs", "hubs", "text").mapInArrow(
        released(run), "set_id binary, links bigint, root binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    recall: float = RECALL, size: int = SIZE, chunk_chars: int = CHUNK_CHARS,
                    chunk_members: int = CHUNK_MEMBERS) -> DataFrame:
    """One row for each document: (doc_id, text_id, class_id, links, copies).

    Texts are linked if the Jaccard similarity of their n-grams is ``similarity``
    or more; words are compared in lower case without punctuation.  A class is a
    connected component and its id the smallest ``doc_id`` in it; ``links``
    counts the other documents a document is linked to, and ``copies`` the
    documents with its very set of n-grams, itself included.  ``text_id`` is a digest
    of the text.

    A text of fewer words than ``size`` has one n-gram, all its words; texts
    without words are linked if they are equal, and a null text is an empty one.
    Repeated rows are copies of each other.  A document without an id takes part
    like others; a class of only such documents has no id.  Extra columns are
    ignored; an empty table has no classes.
    """
    bands, rows = bands_and_rows(similarity, recall)
    source = docs.select(col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    source = source.select("doc_id", digest(F.col("text")).alias("text_id"), "text")
    signed = materialize(_signed(source, size, bands, rows))
    sets = signed.groupBy("set_id").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("class_id"), F.any_value("bands").alias("bands"),
        F.min(F.struct(order_key(F.col("doc_id")).alias("order_key"), F.col("text_id"))).alias("first"))
    sets = materialize(sets)

    banded = sets.select("set_id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("set_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    member = materialize(banded.join(buckets.select("band", "hub"), "band").groupBy("set_id").agg(
        F.collect_set("hub").alias("hubs")))

    # The text of one document of each class that has a candidate.
    wanted = member.join(sets, "set_id").select(
        "set_id", "docs", "hubs", F.col("first.order_key.doc_id").alias("first_id"),
        F.col("first.text_id").alias("first_text"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) &
                        (F.col("text_id") == F.col("first_text"))).select("set_id", "docs", "hubs", "text")
    pieces = texts.select("*", F.explode("hubs").alias("hub"))
    sizes = _chunks(texts, chunk_chars, chunk_members)
    links = materialize(_verified(_dealt(pieces, sizes), similarity, size))

    roots = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    known = sets.select("set_id", "docs", "class_id").join(
        roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").join(counted, "set_id", "left")
    known = known.withColumn("root", F.coalesce("root", "set_id"))
    least = known.groupBy("root").agg(F.min("class_id").alias("class_id"))
    known = known.drop("class_id").join(least, "root")
    return signed.select("doc_id", "text_id", "set_id").join(known, "set_id").select(
        F.col("doc_id"), "text_id", "class_id", "root",
        (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links"), F.col("docs").alias("copies"))


def _chunks(texts: DataFrame, chunk_chars: int, chunk_members: int) -> DataFrame:
    """(hub, chunks) so that neither the text nor the members of a chunk are too many."""
    sizes = texts.select(F.explode("hubs").alias("hub"), F.length("text").alias("chars")).groupBy("hub").agg(
        F.sum("chars").alias("chars"), F.count("*").alias("members"))
    return sizes.select("hub", F.greatest(F.ceil(F.col("chars") / chunk_chars), F.ceil(
        F.col("members") / chunk_members)).cast("int").alias("chunks"))


def _dealt(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of cells dealt to the blocks of their chunk with itself and with each other chunk."""
    joined = pieces.join(sizes, "hub")
    own = F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")
    joined = joined.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return joined.select(
        "hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("second"), "set_id", "docs", "hubs", "text")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of one document of each class: the one with the smallest id, those without an id last.

    All columns stay.  Rows that repeat a document (same id, same text) count
    once: one of them stays.
    """
    found = near_duplicates(docs, doc_id, text, **options)
    key, at, n = fresh(docs, "kept_id", "kept_text", "repeats")
    first = found.groupBy("root").agg(F.min(F.struct(order_key(F.col("doc_id")).alias("order_key"), F.col("text_id"))).alias("first"))
    rows = found.groupBy("doc_id", "text_id").agg(F.count("*").alias("repeats"))
    chosen = first.select(F.col("first.order_key.doc_id").alias(key), F.col("first.text_id").alias(at))
    chosen = materialize(chosen.join(rows, F.col(key).eqNullSafe(F.col("doc_id")) & (F.col(at) == F.col("text_id")))
                         .select(key, at, F.col("repeats").alias(n)))
    same = col(doc_id).eqNullSafe(col(key)) & (digest(whole_text(text)) == col(at))
    once = docs.join(chosen.filter(col(n) == 1), same, "left_semi")
    more = docs.join(chosen.filter(col(n) > 1), same).dropDuplicates([key, at])
    return once.unionByName(more.select(*[col(c) for c in docs.columns]))
