"""Quality of documents: random-indexing word vectors, a two-layer network, calibrated probabilities.

Every word has a sparse random index vector that follows from its hash.  Its
context vector is the sum of the index vectors around all its occurrences in the
whole corpus; words share ``BUCKETS`` rows, so the table's size is fixed.  Each
task adds up its own table of whole numbers and Spark sums the tables by row, so
the result does not depend on the order of tasks.  A document is the mean of
its words' vectors.  A network with one hidden layer learns from a bounded
sample of labelled documents; its temperature is fitted on a part it did not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veil.llm.rows import Words, hash64, released, whole_text
from veil.llm.training import logistic, training_rows, with_scores

#: Rows of the table of words, then the marks: a word in capitals, a word repeated at once, a number.
BUCKETS, MARKS = 8192, 3
ROWS = BUCKETS + MARKS
#: Numbers in a vector, those of an index vector that are not zero, and how far a word's context reaches.
WIDTH, NONZERO, REACH = 48, 2, 2
#: Labelled documents learned from.
MOST_ROWS = 16_000
HIDDEN, EPOCHS, SEED = 32, 60, 7
#: Words whose rows a task remembers.
VOCABULARY = 150_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CAPITALS, _NUMBER = 1 << 20, 1 << 21


def _code(token: str) -> int:
    code = hash64(token.lower()) % BUCKETS
    if len(token) > 1 and token.isupper():
        code |= _CAPITALS
    if token.isdigit():
        code |= _NUMBER
    return code


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the numbers that are not zero, for each row of the table."""
    draw = np.random.default_rng(SEED)
    return draw.integers(0, WIDTH, (ROWS, NONZERO)), draw.choice([-1, 1], (ROWS, NONZERO))


class _Tokens:
    def __init__(self):
        self._codes = Words(_code, most=VOCABULARY)

    def rows(self, text: str) -> np.ndarray:
        """Rows of the table for a text's words, marks behind the word they belong to."""
        codes = self._codes.array(_TOKEN.findall(text), np.int64)
        rows = codes & (BUCKETS - 1)
        again = np.zeros(len(rows), dtype=bool)
        again[1:] = rows[1:] == rows[:-1]
        marks = [(codes & _CAPITALS) > 0, again, (codes & _NUMBER) > 0]
        places = [np.flatnonzero(m) for m in marks]
        if not any(len(p) for p in places):
            return rows
        at = np.concatenate(places) + 1
        return np.insert(rows, at, np.repeat(BUCKETS + np.arange(MARKS), [len(p) for p in places]))


def context_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The context vectors of all rows of the table, from every document: a matrix of fixed size."""
    places, signs = index_vectors()
    names = [f"c{i}" for i in range(WIDTH)]

    def run(batches):
        tokens, total = _Tokens(), np.zeros(ROWS * WIDTH)
        gap = np.full(REACH, -1, dtype=np.int64)

        def add(held: list[np.ndarray]) -> None:
            rows = np.concatenate(held)
            for far in range(1, REACH + 1):
                a, b = rows[:-far], rows[far:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for word, near in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        total.__iadd__(np.bincount(word * WIDTH + places[near, k], weights=signs[near, k],
                                                   minlength=ROWS * WIDTH))

        for batch in batches:
            held, size = [], 0
            for t in batch.column(0).to_pylist():
                held += [tokens.rows(t), gap]
                size += len(held[-2])
                if size > 500_000:
                    add(held)
                    held, size = [], 0
            if held:
                add(held)
        table = np.rint(total.reshape(ROWS, WIDTH)).astype(np.int64)
        some = np.flatnonzero(table.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(table[some, i]) for i in range(WIDTH)]],
                                             ["row", *names])

    parts = docs.select(whole_text(text).alias("text")).mapInArrow(
        released(run), "row bigint, " + ", ".join(f"{n} bigint" for n in names))
    sums = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((ROWS, WIDTH))
    out[sums["row"].to_numpy(dtype=np.int64)] = sums[names].to_numpy(dtype=np.float64)
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Index vector and context vector side by side, each of length one."""
    places, signs = index_vectors()
    own = np.zeros((ROWS, WIDTH))
    np.add.at(own, (np.arange(ROWS)[:, None], places), signs)

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    return np.hstack([unit(own), unit(contexts)]).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, tokens: _Tokens) -> np.ndarray:
    """A row for each text: the mean of its words' vectors and the logarithm of its length."""
    out = np.zeros((len(texts), vectors.shape[1] + 1))
    for i, text in enumerate(texts):
        rows = tokens.rows(text)
        if len(rows):
            counts = np.unique(rows, return_counts=True)
            out[i, :-1] = (counts[1] @ vectors[counts[0]]) / len(rows)
            out[i, -1] = np.log1p(len(rows)) / 10
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    second: tuple[np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.centre) / self.scale) @ self.first[0] + self.first[1])
        return hidden @ self.second[0] + self.second[1]

    def score(self, texts: list[str], tokens: _Tokens) -> np.ndarray:
        return logistic(self.logits(pooled(texts, self.vectors, tokens)) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """A network with one hidden layer, then its temperature on the fifth of the rows kept back.

    Without rows, or with one label only, every score is the share of ones (0.5 without rows).
    """
    width = vectors.shape[1] + 1
    draw = np.random.default_rng(SEED)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return QualityModel(vectors, np.zeros(width), np.ones(width), (np.zeros((width, 1)), np.zeros(1)),
                            (np.zeros(1), float(np.log(share / (1 - share)))), 1.0)
    order = draw.permutation(len(y))
    cut = max(1, len(y) // 5)
    back, seen = order[:cut], order[cut:]
    centre, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-3
    p = [draw.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN),
         draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    mean, square = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z = (x - centre) / scale
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(draw.permutation(seen), max(1, len(seen) // 128)):
            if not len(rows):
                continue
            h = np.tanh(z[rows] @ p[0] + p[1])
            error = (logistic(h @ p[2] + p[3][0]) - y[rows]) / len(rows)
            below = np.outer(error, p[2]) * (1 - h * h)
            slopes = [z[rows].T @ below + 1e-4 * p[0], below.sum(axis=0), h.T @ error + 1e-4 * p[2],
                      np.array([error.sum()])]
            step += 1
            for a, g, m, s in zip(p, slopes, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                a -= 0.005 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    model = QualityModel(vectors, centre, scale, (p[0], p[1]), (p[2], float(p[3][0])), 1.0)
    logits, truth = model.logits(x[back]), y[back]

    def loss(t: float) -> float:
        q = np.clip(logistic(logits / t), 1e-9, 1 - 1e-9)
        return float(-(truth * np.log(q) + (1 - truth) * np.log(1 - q)).mean())

    model.temperature = min(np.geomspace(0.5, 8, 33), key=loss)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
                text: str = "text", most: int = MOST_ROWS) -> QualityModel:
    """Context vectors from all documents, the network from at most ``most`` labelled ones."""
    vectors = word_vectors(context_table(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        tokens = _Tokens()
        for batch in batches:
            x = pooled(batch.column(0).to_pylist(), shared.value, tokens).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())),
                 batch.column(1)], ["x", "label"])

    rows = training_rows(docs, labels, label, most, doc_id, text).mapInArrow(run, "x array<float>, label int")
    got = rows.toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), vectors.shape[1] + 1)
    # The rows come in any order; learn from them in one order.
    y = got["label"].to_numpy(dtype=np.float64)
    order = np.lexsort(np.column_stack([x[:, :8], y]).T) if len(y) else np.arange(0)
    return train(x[order], y[order], vectors)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """All rows with the probability that the label is 1.

    An empty or null text is scored as a document without words; equal texts get
    equal scores; an empty table stays empty; a column named ``out`` is kept and
    the score gets underscores after its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        tokens = _Tokens()
        return lambda texts: shared.value.score(texts, tokens)

    return with_scores(docs, text, scorer, out)
