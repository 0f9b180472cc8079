"""Phrase collocations by marginalising the longest windows.

Every word occurrence opens one window: itself and the three words that follow
it in its piece of text, as four lead columns, padded where the piece ends.  Only
these longest windows are counted; ``ROLLUP`` over the four columns sums them to
the counts of all shorter phrases, down to the words of a language.

Before that, runs of two and then of three neighbours are counted in a table of
cells of fixed size.  A cell below the least count proves that its runs, and so
all phrases over them, are rarer: windows are cut there.  Runs that share a cell
can only let a window stay longer than it has to be, so counts from the least
count on are exact at every size of the corpus.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veil.llm.rows import Words, col, hash64, whole_text, windows
from veil.operators.materialize import materialize

ORDER, LEAST, TOP, SHARE = 4, 30, 2000, 80
#: Cells of a table of runs, and the cells of one row of it on the way to the driver: 8 MB of bits in all.
CELL_BITS, ROW_BITS = 26, 16
#: Tables of runs: of two words and of three.
TABLES = 2
#: Characters of text that are split at once, and words whose hash or number is kept at once.
SLICE, VOCABULARY = 1_000_000, 200_000
#: Candidates of a language are ranked in so many parts first.
PARTS = 64
WORDS = [f"w{k + 1}" for k in range(ORDER)]

_END = b"."
#: Bytes A-Z in lower case, all ends of pieces as one byte that no word has, a tab as a blank.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _END * 9 + b" ")


class _Numbers(dict):
    """Words numbered as they come, and their hashes; number 0 is the padding, number 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, _END: 1})
        self._hashes = np.zeros(0, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def hashes(self) -> np.ndarray:
        added = [hash64(w) for w in islice(self, len(self._hashes), None)]
        self._hashes = np.concatenate([self._hashes, np.array(added, dtype=np.uint64)])
        return self._hashes


def _slices(batch: pa.RecordBatch):
    """(lang, tokens) of the texts of a batch (lang, text), piece ends as tokens, a bounded number of characters at once."""
    texts: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def tokens(lang):
        sizes[lang] = 0
        return _END.join([b"", *texts.pop(lang), b""]).translate(_BYTES).replace(_END, b" . ").split()

    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
        sizes[lang] = sizes.get(lang, 0) + len(text)
        if sizes[lang] > SLICE:
            yield lang, tokens(lang)
    for lang in list(texts):
        yield lang, tokens(lang)


def _frequent(lang: str, hashes: np.ndarray, word: np.ndarray, tables: list[np.ndarray], cell_bits: int):
    """For runs of one word, two words, ...: whether a run begins here and may be frequent, and its cells if it is counted.

    A run may be frequent if both runs that are a word shorter may be, and if the table of its size does not deny it.
    """
    seeded = hashes ^ np.uint64(hash64(lang))
    may, size = word, 1
    while True:
        yield may
        size += 1
        at = np.flatnonzero(may[:-1] & may[1:])
        cells = (windows(seeded, size)[at] >> np.uint64(64 - cell_bits)).astype(np.int64) if len(at) else at
        if size - 2 == len(tables):
            yield cells
            return
        bits = (tables[size - 2][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
        may = np.zeros(len(word), dtype=bool)
        may[at[bits == 1]] = True


def _cell_counts(docs: DataFrame, tables, least: int, cell_bits: int) -> DataFrame:
    """(cell, times) of runs one word longer than the tables know, from each task, up to the least count that matters."""
    def run(batches):
        words, end = Words(most=VOCABULARY), hash64(_END)
        known = [t.value for t in tables]
        counts = np.zeros(2**cell_bits, dtype=np.uint8 if least < 2**8 else np.int64)
        for batch in batches:
            for lang, tokens in _slices(batch):
                hashes = words.array(tokens)
                *_, found = _frequent(lang, hashes, hashes != end, known, cell_bits)
                cells, times = np.unique(found, return_counts=True)
                counts[cells] = np.minimum(counts[cells] + times, least)
        for start in range(0, len(counts), 2**22):
            found = np.flatnonzero(counts[start:start + 2**22]) + start
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), pa.array(counts[found].astype(np.int64))], ["cell", "times"])

    return docs.mapInArrow(run, "cell int, times bigint")


def frequent_cells(docs: DataFrame, tables, least: int, cell_bits: int) -> np.ndarray:
    """One bit for each cell: whether its runs may occur ``least`` times.  The table's size is fixed."""
    counted = _cell_counts(docs, tables, least, cell_bits).groupBy("cell").agg(F.sum("times").alias("times"))
    row_bits = min(ROW_BITS, cell_bits)
    rows = counted.filter(F.col("times") >= least).groupBy(
        F.shiftright("cell", row_bits).alias("row")).agg(
        F.collect_list((F.col("cell") % 2**row_bits).cast("int")).alias("cells"))

    def run(batches):
        for batch in batches:
            packed = []
            for cells in batch.column(1):
                bits = np.zeros(2**row_bits, dtype=bool)
                bits[cells.values.to_numpy()] = True
                packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["row", "bits"])

    table = np.zeros((2**(cell_bits - row_bits), max(1, 2**row_bits // 8)), dtype=np.uint8)
    for row, bits in rows.mapInArrow(run, "row int, bits binary").collect():
        table[row] = np.frombuffer(bits, dtype=np.uint8)
    return table.reshape(-1)


def longest_windows(docs: DataFrame, tables, cell_bits: int) -> DataFrame:
    """(lang, w1 .. w4, times): one window for each word occurrence, cut at the end of its piece and at rare runs.

    Windows of a word alone are summed in the task, in a bounded vocabulary.
    """
    def run(batches):
        denied = [t.value for t in tables]

        def batch_of(lang, numbers, words, times):
            names = pa.array(words, pa.binary()).cast(pa.string())
            size = len(times)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]).take(pa.array(np.zeros(size, dtype=np.int32))),
                 *[names.take(pa.array(n)) for n in numbers], pa.array(times.astype(np.int64))],
                ["lang", *WORDS, "times"])

        def alone(lang):
            words, counts = known.pop(lang), singles.pop(lang)
            found = np.flatnonzero(counts[:len(words)])
            if len(found):
                none = np.zeros(len(found), dtype=np.int64)
                yield batch_of(lang, [found, *[none] * (ORDER - 1)], list(words), counts[found])

        known: dict[str, _Numbers] = {}
        singles: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, tokens in _slices(batch):
                ids = known.setdefault(lang, _Numbers())
                at = np.fromiter(map(ids.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                word, *longer, _ = _frequent(lang, ids.hashes()[at], at > 1, denied, cell_bits)
                while len(longer) < ORDER - 1:  # beyond the tables a run may be frequent if both shorter ones may be
                    longer.append(np.append(longer[-1][:-1] & longer[-1][1:], False))
                counts = np.bincount(at[word & ~longer[0]], minlength=len(ids))
                counts[:len(singles.get(lang, ()))] += singles.get(lang, 0)
                singles[lang] = counts
                starts = np.flatnonzero(longer[0])
                if len(starts):
                    padded = np.concatenate([at, np.zeros(ORDER, dtype=np.int64)])
                    columns = [padded[starts]]
                    columns += [np.where(may[starts], padded[starts + k], 0) for k, may in enumerate(longer, 1)]
                    yield batch_of(lang, columns, list(ids), np.ones(len(starts), dtype=np.int64))
                if sum(map(len, known.values())) > VOCABULARY:
                    for full in list(known):
                        yield from alone(full)
        for lang in list(known):
            yield from alone(lang)

    return docs.mapInArrow(run, f"lang string, {', '.join(w + ' string' for w in WORDS)}, times bigint")


def phrase_counts(opened: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, f) of all phrases that occur often enough; size 0 has all words of the language."""
    counted = opened.groupBy("lang", *WORDS).agg(F.sum("times").alias("times"))
    rolled = counted.rollup("lang", *WORDS).agg(F.sum("times").alias("f"), F.grouping_id().alias("level"))
    words = rolled.withColumn("size", F.lit(ORDER) - F.bit_count("level")).filter(
        (F.col("size") >= 0) & ((F.col("f") >= least) | (F.col("size") == 0)))
    # A padded window is no phrase of its full length; the shorter sums have it.
    last = F.element_at(F.array(F.lit("-"), *WORDS), F.col("size") + 1)
    return words.filter(last != "").select(
        "lang", "size", F.concat_ws(" ", *[F.when(F.col("size") > k, F.col(w)) for k, w in enumerate(WORDS)]).alias(
            "phrase"), "f")


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(19,0)")


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _cut_scores(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): each candidate under its lowest-scoring cut.

    Counts of the parts come by two joins.  A first part that begins very many
    phrases is a frequent key on one side only, which Spark splits at run time.
    """
    candidates = phrases.filter("size >= 2").withColumn("words", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"),
                             F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.col("words"), F.lit(1), F.col("k"))).withColumn(
        "rest", _part(F.col("words"), F.col("k") + 1, F.size("words")))
    parts = phrases.filter(f"size between 1 and {ORDER - 1}").select("lang", F.col("phrase"), "f")
    for side, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    wide = {x: f"cast({x} as decimal(19,0))" for x in "alr"}
    score = F.expr(f"2000000 * {wide['a']} div ({wide['l']} + {wide['r']})")
    best = F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent longer candidate that has the phrase in it."""
    words = F.split("phrase", " ")
    spans = [F.struct(F.lit(start).alias("start"), F.lit(size).alias("size"), F.lit(whole).alias("whole"))
             for whole in range(3, ORDER + 1) for size in range(2, whole) for start in range(1, whole - size + 2)]
    inner = phrases.filter("size >= 3").select(
        "lang", "f", F.explode(F.transform(
            F.filter(F.array(*spans), lambda s: s["whole"] == F.col("size")),
            lambda s: F.array_join(F.slice(words, s["start"], s["size"]), " "))).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
                 share: int = SHARE, cell_bits: int = CELL_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two to four words of each language.

    A-Z count as lower case; texts fall into pieces at ``.,;:!?`` and line
    breaks, pieces into words at blanks and tabs.  A phrase counts if it occurs
    ``least`` times, overlaps included.  Its score is 2,000,000 times its count
    by the counts of the two parts of its worst cut, rounded down.  It is left
    out if a longer phrase around it has ``share`` percent of its count.

    Null texts are empty and have no words; a null language is ``und``; repeated
    rows count as often as they stand there; other columns are ignored; tables
    without a frequent phrase, and empty ones, give no rows.  Equal scores are
    ordered by count, then by the bytes of the phrase.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"),
                         whole_text(text).cast("binary").alias("text"))
    tables: list = []
    for _ in range(TABLES):
        tables.append(spark.sparkContext.broadcast(frequent_cells(source, list(tables), least, cell_bits)))
    phrases = materialize(phrase_counts(longest_windows(source, tables, cell_bits), least))
    scored = _cut_scores(phrases).join(_covered(phrases), ["lang", "phrase"], "left")
    left = scored.filter(F.col("longer").isNull() | (
        _exact("longer") * 100 < _exact("a") * share)).drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may have most of the phrases: each part keeps its first ones, then those are ranked.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = left.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(
        F.col("rank") <= top)
    totals = phrases.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
