"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and back.

Texts are split by the vocabulary's pattern.  Per block of documents (a few MB)
every distinct word is merged once: the pair with the lowest rank first, the
leftmost of equals, until no neighbours are a token together.  The fold runs in
numpy over all words of a length at once, with the ranks in a broadcast table
whose size is that of the vocabulary.  Nothing is shuffled, and memory is bounded
by the block, whatever the number of distinct words in the corpus.

The same fold with Spark's higher-order functions gives the same ids but takes
160 microseconds of CPU for a word; the README has the figures.

Decoding looks every id up in the table of byte pieces and concatenates them.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.llm.rows import col, extended, fresh, gather, mapped, ragged, whole_text

#: Characters of text in a block; a longer document makes a block of its own.
BLOCK_CHARS = 2_000_000
#: Ids that are decoded at once.
PART_IDS = 500_000
#: Above every rank.
NONE = np.int64(2**40)
#: Words of more bytes are merged one by one, with a heap.
LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Merges:
    """The tables of a vocabulary: ids of bytes, ranks of pairs, pieces of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[(left << 32) + right] = rank
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[int(k)] for k in self.keys], dtype=np.int64)
        pieces = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece_lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that neighbours make together, or NONE."""
        if not len(self.keys):
            return np.full(np.shape(left), NONE)
        wanted = (left << 32) + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.made[at], NONE)

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        lengths = np.array([len(w) for w in raw], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        order, parts, counts = [], [], np.zeros(len(raw), dtype=np.int64)
        made = self._pairs() if len(lengths) and lengths.max() > LONG else {}
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            if length > LONG:
                own = [self._long(raw[i], made) for i in at]
                counts[at] = [len(x) for x in own]
                parts.append(np.concatenate(own))
            elif length:
                ids = self._same_length(self.first[data[starts[at][:, None] + np.arange(length)]])
                counts[at] = (ids >= 0).sum(axis=1)
                parts.append(ids[ids >= 0])
            order.append(at)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        grouped = np.concatenate(order) if order else np.zeros(0, np.int64)
        begins = np.zeros(len(raw), dtype=np.int64)
        begins[grouped] = np.cumsum(counts[grouped]) - counts[grouped]
        return gather(flat, begins, counts), counts

    def _same_length(self, ids: np.ndarray) -> np.ndarray:
        """The fold over a matrix with a word in each row; -1 stands behind a word's last id."""
        rows, width = ids.shape
        ids = np.hstack([ids, np.full((rows, 1), -1, dtype=np.int64)])
        ranks = np.hstack([self.rank(ids[:, :-1], ids[:, 1:]), np.full((rows, 1), NONE)])
        places = np.arange(width)
        live = np.arange(rows)
        while len(live):
            at = ranks[live].argmin(axis=1)
            best = ranks[live, at]
            live, at, best = live[best < NONE], at[best < NONE], best[best < NONE]
            if not len(live):
                break
            taken = places + (places > at[:, None])
            ids[live, :width] = np.take_along_axis(ids[live], taken, axis=1)
            ranks[live, :width] = np.take_along_axis(ranks[live], taken, axis=1)
            ids[live, at] = best
            ranks[live, at] = self.rank(best, ids[live, at + 1])
            inner = at > 0
            row, left = live[inner], at[inner] - 1
            ranks[row, left] = self.rank(ids[row, left], best[inner])
        return ids[:, :width]

    def _long(self, word: bytes, made: dict[int, int] | None = None) -> np.ndarray:
        """The same for a long word: a heap of pairs and a linked list, so that time is n log n."""
        ids = [int(i) for i in self.first[np.frombuffer(word, dtype=np.uint8)]]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        made = self._pairs() if made is None else made
        heap = [(r, i) for i in range(len(ids) - 1) if (r := made.get((ids[i] << 32) + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or made.get((ids[i] << 32) + ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < len(ids):
                    r = made.get((ids[a] << 32) + ids[b])
                    if r is not None:
                        heapq.heappush(heap, (r, a))
        return np.array([i for i in ids if i >= 0], dtype=np.int64)

    def _pairs(self) -> dict[int, int]:
        """Ids of pairs.  Not kept: objects that outlive a task would hold the memory around them in the worker."""
        return dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))

    def pieces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after another, and how many each has."""
        lengths = self.piece_lengths[ids]
        return gather(self.piece_bytes, self.piece_starts[ids], lengths), lengths


class Vocabulary:
    """A vocabulary file's tables, broadcast; their size is that of the file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.pattern = pattern
        self.merges = spark.sparkContext.broadcast(Merges(read_ranks(path)))


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    return regex.compile(pattern)


class _Numbers(dict):
    """Numbers of chunks, given as they come; -1 for a chunk that cannot be split by itself."""

    def __init__(self, new: list[str], space: str):
        super().__init__()
        self._new, self._space = new, space

    def __missing__(self, part: str) -> int:
        if self._space and (not part or part[0].isspace() or part[-1].isspace()):
            n = -1
        else:
            n = len(self._new)
            self._new.append(self._space + part)
        self[part] = n
        return n


class Coder:
    """Ids of texts, block by block; chunks that came before are known, up to a bounded number of them.

    A chunk is what stands between single spaces, with the space before it.  The
    pattern takes at most one space together with what follows, so it splits a
    chunk as it splits the text, unless other white space meets the space; such
    texts are split whole.
    """

    def __init__(self, pattern: str, merges: Merges, most: int = 200_000):
        self._split, self._merges, self._most = _splitter(pattern).findall, merges, most
        self._forget()

    def _forget(self) -> None:
        self._chunks: list[str] = []
        self._spaced, self._plain = _Numbers(self._chunks, " "), _Numbers(self._chunks, "")
        self._ids = np.zeros(0, dtype=np.int32)
        self._starts = self._lengths = np.zeros(0, dtype=np.int64)

    def _numbered(self, text: str) -> np.ndarray:
        head, *rest = text.split(" ")
        if not (head and head[-1].isspace()):
            own = np.fromiter(map(self._spaced.__getitem__, rest), dtype=np.int64, count=len(rest))
            if not len(own) or own.min() >= 0:
                return np.concatenate([[self._plain[head]], own]) if head else own
        parts = self._split(text)
        return np.fromiter(map(self._plain.__getitem__, parts), dtype=np.int64, count=len(parts))

    def _learn(self) -> None:
        """Ids of the chunks that are new since the last block; each distinct word is merged once."""
        words: dict[str, int] = {}
        of_chunk = [[words.setdefault(w, len(words)) for w in self._split(c)]
                    for c in self._chunks[len(self._starts):]]
        if not of_chunk:
            return
        ids, counts = self._merges.words([w.encode("utf-8", "surrogatepass") for w in words])
        flat = np.array([w for c in of_chunk for w in c], dtype=np.int64)
        ends = np.cumsum(np.array([len(c) for c in of_chunk], dtype=np.int64))
        before = np.concatenate([[0], np.cumsum(counts[flat])])
        last = before[ends] + len(self._ids)
        first = np.concatenate([[len(self._ids)], last[:-1]])
        starts = np.cumsum(counts) - counts
        self._ids = np.concatenate([self._ids, gather(ids, starts[flat], counts[flat]).astype(np.int32)])
        self._starts = np.concatenate([self._starts, first])
        self._lengths = np.concatenate([self._lengths, last - first])

    def block(self, texts: list[str]) -> pa.ListArray:
        if len(self._chunks) > self._most:
            self._forget()
        numbered = [self._numbered(t) for t in texts]
        self._learn()
        flat = np.concatenate(numbered) if numbered else np.zeros(0, np.int64)
        lengths = self._lengths[flat]
        before = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(np.array([len(x) for x in numbered], dtype=np.int64))
        counts = np.diff(before[np.concatenate([[0], last])])
        return ragged(gather(self._ids, self._starts[flat], lengths), counts, pa.int32())


def ranges(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of rows with a size of about ``most`` together; a larger row is a range of its own."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            out.append((start, i))
            start, total = i, 0
        total += size
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def _place(df: DataFrame, name: str, kind: str) -> int | None:
    """Where a column of that very type is; tasks read it there, and it is not sent to them twice."""
    same = [c for c in df.columns if c.lower() == name.lower()]
    return df.dtypes.index((name, kind)) if len(same) == 1 and (name, kind) in df.dtypes else None


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All rows with a further column of the token ids of their whole text.

    A null or empty text has no ids; no special tokens are made, their spellings
    are ordinary text.  Rows that repeat are encoded alike, an empty table gives
    an empty one.  If the table has a column named ``ids``, the new one gets
    underscores after its name.
    """
    pattern, shared = vocabulary.pattern, vocabulary.merges
    place = _place(df, text, "string")
    inputs = [whole_text(text)] if place is None else []
    n_inputs = len(inputs)

    def run(batches):
        coder = Coder(pattern, shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1 if place is None else place)
            for start, end in ranges(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), block_chars):
                made = coder.block([t or "" for t in texts.slice(start, end - start).to_pylist()])
                yield extended(batch.slice(start, end - start), n_inputs, [made])

    return mapped(df, inputs, run, {fresh(df, ids)[0]: "array<int>"})


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "bytes",
           ids_sha256: str | None = None) -> DataFrame:
    """All rows with a further column of the bytes of their ids: the pieces, concatenated.

    Null or no ids give no bytes; ids out of the vocabulary are an error.  With
    ``ids_sha256`` a column of that name follows: the SHA-256, in lowercase hex, of
    the ids as little-endian unsigned 32-bit integers.  Names that are taken get
    underscores.
    """
    shared = vocabulary.merges
    names = fresh(df, out, *([ids_sha256] if ids_sha256 else []))
    place = _place(df, ids, "array<int>")
    inputs = [F.coalesce(col(ids), F.array().cast("array<int>"))] if place is None else []
    n_inputs = len(inputs)

    def taken(batch: pa.RecordBatch) -> tuple[pa.ListArray, pa.Array]:
        lists = batch.column(batch.num_columns - 1 if place is None else place)
        return lists, pc.fill_null(lists.value_lengths(), 0)

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, sizes = taken(batch)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))]).astype(np.int64)
        data, lengths = shared.value.pieces(flat)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[ends].astype(np.int32)
        made = [pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows,
                                            [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])]
        if ids_sha256:
            raw, at = flat.astype("<u4"), ends.tolist()
            made.append(pa.array([sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]))
        return extended(batch, n_inputs, made)

    def run(batches):
        for batch in batches:
            for start, end in ranges(taken(batch)[1].to_pylist(), PART_IDS):
                yield part(batch.slice(start, end - start))

    return mapped(df, inputs, run, dict(zip(names, ("binary", "string"), strict=False)))
