"""Line deduplication by pairwise alignment.

Documents are paired through shared runs of lines.  The shortest runs
from and up to every line that have enough text for a block are keys; a line that
is long enough is one by itself, however frequent.  Every line of a block worth
deleting lies in a key inside the block.  A key pairs each later document with the earliest
that has it; places that the alignment leaves uncovered go on to the next
documents that have their keys, twice as many in each round, until none are left.
So the number of pairs follows the number of lines, not its square, unless a key
stays uncovered in many documents.

Lines are read once, as flat arrays of hashes and sizes for a batch of texts.
The earliest text of a key is an aggregate, and only keys that are still open get
an order of their texts, in two steps, so no task sorts the texts of a frequent
line.  For the alignments the partners of an earlier text are dealt to tasks, each
of which gets its lines once and the partners one after another.

A pair is aligned by patience diff on line hashes: lines that stand once in both
are the anchors, the longest run of anchors in order is kept, and matches grow
from there; between anchors the longest common runs follow.  Aligned blocks with
enough text are deleted from the later document.  Of equal texts the earliest
document stays whole and the others lose all their lines.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from veil.llm.rows import col, digest, fresh, mixed, order_key, ragged, released, whole_text
from veil.operators.materialize import materialize

#: Characters without white space that a block needs at least.
BLOCK_CHARS = 40
#: Partners of one text that a task aligns with it; parts into which the texts of a key are dealt to find the first ones.
PARTNERS, PARTS = 500, 16
#: Characters of text that are split into lines at once.
SLICE = 4_000_000
_FACTOR = 0xD6E8FEB86659FD93
_WHITE = " \t\n\x0b\x0c\r"


def least_runs(sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of ``least`` characters from each line that is not blank."""
    ahead = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.flatnonzero(sizes > 0)
    ends = np.searchsorted(ahead, ahead[starts] + least)
    return starts[ends <= len(sizes)], ends[ends <= len(sizes)]


def key_runs(sizes: np.ndarray, least: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs from and up to each line: every line of a block lies in one inside it.

    ``bounds`` are the edges of the texts whose lines stand one after another in ``sizes``.
    """
    bounds = np.array([0, len(sizes)]) if bounds is None else bounds
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ahead = np.concatenate([[0], np.cumsum(sizes)])
    filled = np.flatnonzero(sizes > 0)
    ends = np.searchsorted(ahead, ahead[filled] + least)
    inside = ends <= bounds[text[filled] + 1]
    enough = ahead[filled + 1] - ahead[bounds[text[filled]]] >= least
    last = filled[enough] + 1
    spans = np.stack([np.concatenate([filled[inside], np.searchsorted(ahead, ahead[last] - least, side="right") - 1]),
                      np.concatenate([ends[inside], last])])
    spans = spans[:, np.lexsort((spans[1], spans[0]))]
    new = np.ones(spans.shape[1], dtype=bool)
    new[1:] = (spans[:, 1:] != spans[:, :-1]).any(axis=0)
    return spans[0, new], spans[1, new]


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of lines from ``starts`` to before ``ends``."""
    n = len(hashes)
    power = np.cumprod(np.full(n + 1, _FACTOR, dtype=np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(n + 1, pow(_FACTOR, -1, 2**64), dtype=np.uint64), dtype=np.uint64)
    ahead = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(hashes) * power[:n], dtype=np.uint64)])
    return mixed((ahead[ends] - ahead[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first number) whose second numbers grow."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            ends.append(n)
        else:
            tops[at], ends[at] = b, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _longest_run(a: list, b: list, sizes: list[int], least: int) -> list[tuple[int, int]]:
    """The common run with the most text, if that is ``least`` or more; ``sizes`` are those of ``b``."""
    number, size = {x: n for n, x in enumerate(dict.fromkeys([*a, *b]))}, dict(zip(b, sizes, strict=True))
    hashes = [np.array([number[x] for x in s], dtype=np.uint64) for s in (a, b)]
    weights = [np.array([size.get(x, 0) for x in s], dtype=np.int64) for s in (a, b)]
    low, high, best = least, int(min(w.sum() for w in weights)), None
    while low <= high:
        middle = (low + high) // 2
        (s, e), (t, f) = (least_runs(w, middle) for w in weights)
        _, i, j = np.intersect1d(run_hashes(hashes[0], s, e), run_hashes(hashes[1], t, f), return_indices=True)
        if len(i):
            first = np.argmin(j)
            best, low = (int(s[i[first]]), int(t[j[first]])), middle + 1
        else:
            high = middle - 1
    if best is None:
        return []
    (i, j), out = best, []
    while i and j and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
    while i < len(a) and j < len(b) and a[i] == b[j]:
        out.append((i, j))
        i, j = i + 1, j + 1
    return out


def patience(a: list, b: list, sizes: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Matching places of two sequences, in order in both.

    Where no element stands once in both, the longest common run of ``least`` or
    more is the anchor; ``sizes`` of the second sequence say how much its elements count.
    """
    sizes = [1] * len(b) if sizes is None else sizes
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict = {}
        for i in range(a0, a1):
            once[a[i]] = i if a[i] not in once else -1
        other: dict = {}
        for j in range(b0, b1):
            if once.get(b[j], -1) >= 0:
                other[b[j]] = j if b[j] not in other else -1
        anchors = _increasing(sorted((once[x], j) for x, j in other.items() if j >= 0))
        if not anchors:
            anchors = [(a0 + i, b0 + j) for i, j in _longest_run(a[a0:a1], b[b0:b1], sizes[b0:b1], least)]
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common_blocks(earlier: list, later: list, sizes: list[int], least: int = BLOCK_CHARS) -> list[int]:
    """Places in the later sequence that lie in an aligned block of ``least`` characters or more."""
    out, block = [], []
    for a, b in [*patience(earlier, later, sizes, least), (-1, -1)]:
        if block and (a, b) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(sizes[j] for _, j in block) >= least:
                out += [j for _, j in block]
            block = []
        block.append((a, b))
    return out


def text_lines(text: str) -> tuple[list[int], list[int]]:
    """Hash and size of every line; white space at its ends does not count, and none in the size."""
    bare = [x.strip(_WHITE) for x in text.split("\n")]
    hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in bare]
    if any(w in text for w in _WHITE[3:] + "\t"):
        return hashes, [len(x) - sum(map(x.count, _WHITE)) for x in bare]
    return hashes, [len(x) - x.count(" ") for x in bare]


def _key_hashes(hashes: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, least: int, open_: np.ndarray | None = None):
    """(hashes, number for each text): the distinct keys of texts, or those with an open line in them."""
    starts, ends = key_runs(sizes, least, bounds)
    if open_ is not None:
        left = np.concatenate([[0], np.cumsum(open_)])
        some = left[ends] > left[starts]
        starts, ends = starts[some], ends[some]
    text = np.searchsorted(bounds, starts, side="right") - 1
    keys = run_hashes(hashes, starts, ends)
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], np.bincount(text[new], minlength=len(bounds) - 1)


def _read(source: DataFrame, least: int) -> DataFrame:
    """(text_id, doc_id, hashes, sizes, keys) of (text_id, doc_id, text)."""
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["text_id", "doc_id", "hashes", "sizes", "keys"]

    def run(batches):
        for batch in batches:
            texts, a = batch.column(2), 0
            while a < batch.num_rows:
                hashes, sizes, counts, chars, b = [], [], [], 0, a
                while b < batch.num_rows and chars < SLICE:
                    text = texts[b].as_py()
                    h, n = text_lines(text)
                    hashes += h
                    sizes += n
                    counts.append(len(h))
                    chars += len(text)
                    b += 1
                h, n, lengths = np.array(hashes, dtype=np.uint64), np.array(sizes, dtype=np.int64), np.array(counts)
                keys, number = _key_hashes(h, n, np.concatenate([[0], np.cumsum(lengths)]), least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     ragged(h.view(np.int64), lengths, pa.int64()), ragged(n.astype(np.int32), lengths, pa.int32()),
                     ragged(keys.view(np.int64), number, pa.int64())], names)
                a = b

    return source.select("text_id", "doc_id", "text").mapInArrow(
        released(run), f"text_id binary, doc_id {kind}, hashes array<bigint>, sizes array<int>, keys array<bigint>")


def _open_keys(texts: DataFrame, least: int) -> DataFrame:
    """(text_id, hash) of the keys in texts (text_id, hashes, sizes, places) that ``places`` don't cover."""
    def run(batches):
        for batch in batches:
            lists = [batch.column(i) for i in (1, 2)]
            hashes, sizes = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            bounds = lists[0].offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            open_ = np.ones(len(sizes), dtype=np.int64)
            for n, places in enumerate(batch.column(3)):
                if places.is_valid:
                    open_[bounds[n] + places.values.to_numpy()] = 0
            keys, number = _key_hashes(hashes.view(np.uint64), sizes.astype(np.int64), bounds, least, open_)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(number)), number))), pa.array(keys.view(np.int64))],
                ["text_id", "hash"])

    return texts.select("text_id", "hashes", "sizes", "places").mapInArrow(released(run), "text_id binary, hash bigint")


def _firsts(rows: DataFrame, number: int) -> DataFrame:
    """(hash, rank, place) of the first texts of each key, found in parts of its texts and then among those."""
    part = F.pmod(F.xxhash64("place.text_id"), F.lit(PARTS)).alias("part")
    some = rows.select("hash", "place", part).withColumn("rank", F.row_number().over(
        Window.partitionBy("hash", "part").orderBy("place"))).filter(F.col("rank") <= number)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("place"))).filter(
        F.col("rank") <= number).select("hash", "rank", "place")


def _deleted(texts: DataFrame, least: int) -> DataFrame:
    """(text_id, places): the lines in blocks that earlier texts have."""
    rows = texts.select(F.struct("first", "text_id").alias("place"), F.explode("keys").alias("hash"))
    earliest = rows.groupBy("hash").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(rows.join(earliest, "hash"))
    pairs = shared.filter("place != earliest").select(
        F.col("place.text_id").alias("later"), F.col("earliest.text_id").alias("earlier"))
    lines = texts.select("text_id", "hashes", "sizes")
    open_, low, found = shared.filter("place != earliest AND n > 2").select("hash", "place"), 2, None
    while True:
        new = _aligned(pairs.distinct(), lines, least)
        found = materialize((new if found is None else found.unionByName(new)).groupBy("text_id").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")))
        left = lines.join(open_.select(F.col("place.text_id").alias("text_id")).distinct(), "text_id").join(
            found, "text_id", "left")
        still = _open_keys(left, least).select(F.col("text_id").alias("id"), F.col("hash").alias("key"))
        open_ = materialize(open_.join(still, (F.col("place.text_id") == F.col("id")) & (F.col("hash") == F.col("key")),
                                       "left_semi"))
        if open_.isEmpty():
            return found
        # The next partners of the keys that are left: as many as there were, and one that shows whether there are more.
        high = 2 * low - 1
        firsts = materialize(_firsts(shared.select("hash", "place").join(
            open_.select("hash").distinct(), "hash", "left_semi"), high + 1))
        partners = firsts.filter(F.col("rank").between(low, high)).select("hash", F.col("place").alias("before"))
        pairs = open_.join(partners, "hash").filter("before < place").select(
            F.col("place.text_id").alias("later"), F.col("before.text_id").alias("earlier"))
        more = firsts.filter(F.col("rank") == high + 1).select("hash", F.col("place").alias("limit"))
        open_ = open_.join(more, "hash").filter("limit < place").drop("limit")
        low = high + 1


def _aligned(pairs: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """(text_id, deleted places) of the later texts of the pairs (later, earlier)."""
    parts = pairs.groupBy("earlier").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "earlier").select(
        "earlier", "later", F.pmod(F.xxhash64("later"), F.col("parts")).cast("int").alias("part"))
    of_earlier = dealt.select("earlier", "part").distinct().join(
        lines.withColumnRenamed("text_id", "earlier"), "earlier").select(
        "earlier", "part", F.lit(None).cast("binary").alias("later"), "hashes", "sizes")
    of_later = dealt.join(lines.withColumnRenamed("text_id", "later"), "later").select(*of_earlier.columns)
    ordered = of_earlier.unionByName(of_later).repartition("earlier", "part").sortWithinPartitions(
        "earlier", "part", F.col("later").isNotNull())

    def run(batches):
        known: list[int] = []
        for batch in batches:
            ids, found = [], []
            for n in range(batch.num_rows):
                hashes, later = batch.column(1)[n].values.to_numpy(), batch.column(0)[n]
                if not later.is_valid:
                    known = hashes.tolist()
                    continue
                places = common_blocks(known, hashes.tolist(), batch.column(2)[n].values.to_numpy().tolist(), least)
                if places:
                    ids.append(later.as_py())
                    found.append(places)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(found, pa.list_(pa.int32()))],
                                                 ["text_id", "places"])

    return ordered.select("later", "hashes", "sizes").mapInArrow(released(run), "text_id binary, places array<int>")


def line_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = BLOCK_CHARS) -> DataFrame:
    """(text_id, first_id, places) for each distinct text that has something to delete or occurs again.

    ``places`` are the lines that a document with this text loses; documents
    other than the earliest (``first_id``) lose all lines.
    """
    source = docs.select(col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    source = source.select("doc_id", digest(F.col("text")).alias("text_id"), "text")
    key = order_key(F.col("doc_id"))
    texts = materialize(_read(source, least).groupBy("text_id").agg(
        F.min(key).alias("first"), (F.min(key) != F.max(key)).alias("several"),
        F.any_value(F.struct("hashes", "sizes", "keys")).alias("lines")).select("text_id", "first", "several", "lines.*"))
    deleted = _deleted(texts, least)
    return texts.select("text_id", F.col("first.doc_id").alias("first_id"), "several").join(
        deleted, "text_id", "left").filter(F.col("several") | F.col("places").isNotNull()).select(
        "text_id", "first_id", "places")


def delete_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = BLOCK_CHARS,
                        out: str = "n_deleted") -> DataFrame:
    """All rows with their text without the lines that an earlier document has in an aligned block.

    Earlier means a smaller id; documents without an id come last, documents with
    the same id by the digest of their texts.  Rows that repeat a document (same
    id, same text) are one document: all of them keep or lose the same lines.  A
    null text stays null; an empty one has nothing to lose.  Lines without a
    character but white space pair no documents but go with the block around
    them.  A document is aligned with one earlier document at a time: passages
    that none has in its order stay but one.  ``out`` counts the deleted lines
    (underscores follow if the name is taken); an empty table stays empty.
    """
    name, at, first, places, known = fresh(docs, out, "at", "first", "places", "known")
    found = line_duplicates(docs, doc_id, text, least).select(
        F.col("text_id").alias(at), F.col("first_id").alias(first), F.col("places").alias(places),
        F.lit(True).alias(known))
    joined = docs.withColumn(at, digest(whole_text(text))).join(found, at, "left")
    lines = F.split(col(text).cast("string"), "\n", -1)
    copy = col(known) & ~col(doc_id).eqNullSafe(col(first)) & (whole_text(text) != "")

    def kept(parts: Column) -> Column:
        """What stands between two deleted places, one stretch after another."""
        edges = F.concat(F.array(F.lit(-1)), col(places), F.array(F.size(parts)))
        stretches = F.transform(F.slice(edges, F.lit(2), F.size(edges) - 1), lambda end, i: F.slice(
            parts, F.get(edges, i) + 2, end - F.get(edges, i) - 1))
        return F.array_join(F.flatten(stretches), "\n")

    rest = F.when(copy, F.lit("")).when(col(places).isNotNull(), F.get(F.transform(F.array(lines), kept), F.lit(0))) \
        .otherwise(col(text))
    lost = F.when(copy, F.size(lines)).otherwise(F.coalesce(F.size(places), F.lit(0)))
    return joined.select(*[rest.alias(c) if c == text else col(c) for c in docs.columns], lost.alias(name))
