"""Quality rules with line labels: a linear-chain conditional random field marks content and boilerplate.

Each line has a vector of measures (length, symbols, capitals, digits, repeats);
the field adds a score for the step from one line's label to the next, and the
best sequence is found by Viterbi's algorithm.  The share of a document's
characters in content lines decides whether it stays.  The field is trained on
sequences put together from runs of lines of labelled documents, good and bad
in turn, so that it learns both labels and both steps.

Before that come plain rules on the whole text: at least ten words, and at most
a fifth of them in five-word windows that occur twice or more.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veil.llm.rows import Words, extended, fresh, mapped, whole_text, windows
from veil.llm.training import training_rows

#: Labelled documents learned from, and consecutive lines taken of each.
MOST_ROWS, RUN_LINES = 6000, 8
#: Runs in a training sequence.
RUNS = 4
#: A document stays if so much of its characters are content.
CONTENT_SHARE = 0.5
SEED = 11

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _bytes in enumerate((_SPACES, _SYMBOLS, "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?", ".,;:'\"()-"), 1):
    _KINDS[np.frombuffer(_bytes.encode(), dtype=np.uint8)] = _kind
FEATURES = 12


@dataclass
class Lines:
    """A text's words and lines, and the measures of every line that has a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    lengths: np.ndarray
    measures: np.ndarray


def repeated(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Which words stand in a window of ``size`` words that occurs twice or more."""
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    runs = windows(hashes, size)
    ordered = np.sort(runs)
    if len(runs) > 1 and (ordered[1:] == ordered[:-1]).any():
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        at = np.searchsorted(twice, runs)
        found = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == runs)
        np.add.at(covered, found, 1)
        np.add.at(covered, found + size, -1)
    return covered.cumsum()[:-1] > 0


def analyse(text: str, words: Words) -> Lines:
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    split = [line.split() for line in lines]
    counts = np.array([len(s) for s in split], dtype=np.int64)
    flat = list(chain.from_iterable(split))
    hashes = words.array(flat)
    with_word = np.flatnonzero(counts)
    kept = [lines[i] for i in with_word]
    again, before = np.zeros(len(kept)), set()
    for i, line in enumerate(kept):
        if line in before:
            again[i] = 1
        before.add(line)
    spaces = sum(text.count(c) for c in _SPACES)
    found = repeated(hashes)
    out = Lines(len(flat), len(text) - spaces, sum(text.count(c) for c in _SYMBOLS), int(again.sum()),
                int(found.sum()), np.zeros(0), np.zeros((0, FEATURES)))
    if not kept:
        return out
    kinds = _KINDS[np.frombuffer(raw, dtype=np.uint8)]
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    per = np.zeros((7, len(lines)))
    for k in (1, 2, 3, 4, 5, 6):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        per[k] = total[starts + sizes] - total[starts]
    n = counts[with_word]
    per, solid = per[:, with_word], (sizes - per[1])[with_word]
    ends = np.cumsum(n)
    same = np.zeros(len(flat))
    same[1:] = hashes[1:] == hashes[:-1]
    total_same, total_found = np.concatenate([[0], same.cumsum()]), np.concatenate([[0], found.cumsum()])
    measures = np.column_stack([
        np.ones(len(n)), np.log1p(n) / 5, solid / n / 10, per[2] / solid, per[3] / solid, per[4] / solid,
        per[5] / solid, per[6] / solid, (total_same[ends] - total_same[ends - n]) / n,
        (total_found[ends] - total_found[ends - n]) / n, again, (n < 4).astype(float)])
    out.lengths, out.measures = solid.astype(np.float64), measures
    return out


@dataclass
class Field:
    """Weights of the measures for content, and scores of steps [from, to]; label 1 is content."""

    weights: np.ndarray
    steps: np.ndarray

    def best(self, measures: np.ndarray) -> np.ndarray:
        """The labels of the best sequence; of equally good ones the one with boilerplate where they differ last."""
        if not len(measures):
            return np.zeros(0, dtype=np.int64)
        emit = (measures @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b, back = 0.0, emit[0], []
        for e in emit[1:]:
            from_a, from_b = a >= b + s10 - s00, a + s01 >= b + s11
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = (a + s00 if from_a else b + s10), (a + s01 if from_b else b + s11) + e
        labels = [0 if a >= b else 1]
        for pointer in reversed(back):
            labels.append(pointer[labels[-1]])
        return np.array(labels[::-1])

    def content_share(self, lines: Lines) -> float:
        if not len(lines.lengths):
            return 0.0
        return float((lines.lengths * self.best(lines.measures)).sum() / lines.lengths.sum())


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 200, ridge: float = 1e-3) -> Field:
    """Maximises the likelihood of the labels, by forward and backward sums over all sequences at once."""
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    if not sequences:
        field.weights[0] = 1.0
        return field
    length = max(map(len, sequences))
    x = np.zeros((len(sequences), length, FEATURES))
    y = np.zeros((len(sequences), length), dtype=np.int64)
    real = np.zeros((len(sequences), length), dtype=bool)
    for i, (s, t) in enumerate(zip(sequences, labels, strict=True)):
        x[i, :len(s)], y[i, :len(s)], real[i, :len(s)] = s, t, True
    pairs = real[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    params, mean, square = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    total = real.sum()
    for step in range(1, rounds + 1):
        steps = params[FEATURES:].reshape(2, 2)
        emit = np.stack([np.zeros(y.shape), x @ params[:FEATURES]], axis=2)
        ahead, behind = np.zeros(emit.shape), np.zeros(emit.shape)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, length):
            new = _logsum(ahead[:, t - 1, :, None] + steps, 1) + emit[:, t]
            ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _logsum(steps + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], new, 0)
        norm = _logsum(ahead[:, -1], 1)
        share = np.exp(ahead + behind - norm[:, None, None])[:, :, 1]
        both = np.exp(ahead[:, :-1, :, None] + steps + (emit + behind)[:, 1:, None, :] - norm[:, None, None, None])
        slope = np.concatenate([
            (((share - y) * real)[:, :, None] * x).sum(axis=(0, 1)),
            ((both * pairs[:, :, None, None]).sum(axis=(0, 1)) - seen).ravel()]) / total + ridge * params
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        params -= 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Field(params[:FEATURES], params[FEATURES:].reshape(2, 2))


def mosaics(runs: list[np.ndarray], good: np.ndarray, seed: int = SEED) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences of ``RUNS`` runs each, as likely to be good as bad."""
    draw = np.random.default_rng(seed)
    kinds = [np.flatnonzero(good == k) for k in (0, 1)]
    if not len(kinds[0]) or not len(kinds[1]):
        return [], []
    sequences, labels = [], []
    for _ in range(max(1, len(runs) // RUNS)):
        chosen = draw.integers(0, 2, RUNS)
        parts = [runs[draw.choice(kinds[k])] for k in chosen]
        sequences.append(np.concatenate(parts))
        labels.append(np.repeat(chosen, [len(p) for p in parts]))
    return sequences, labels


def fit_lines(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
              text: str = "text", most: int = MOST_ROWS, run_lines: int = RUN_LINES) -> Field:
    """Learns from a run of ``run_lines`` neighbouring lines of each of at most ``most`` labelled documents.

    Both bound what is learned from, not what is judged.  Without documents of
    both labels every line is content.
    """

    def run(batches):
        words = Words()
        for batch in batches:
            runs = []
            for t in batch.column(0).to_pylist():
                m = analyse(t, words).measures
                at = hash(len(t)) % max(1, len(m) - run_lines + 1)
                runs.append(m[at:at + run_lines].ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.list_(pa.float64())), batch.column(1)],
                                             ["run", "label"])

    got = training_rows(docs, labels, label, most, doc_id, text).mapInArrow(run, "run array<double>, label int")
    rows = sorted((tuple(r["run"]), r["label"]) for r in got.collect() if len(r["run"]))
    return train(*mosaics([np.array(r).reshape(-1, FEATURES) for r, _ in rows], np.array([y for _, y in rows])))


#: Columns of the result and their types.
RESULT = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
          "n_repeat_words": "bigint", "base_failed": "boolean", "content_share": "double", "kept": "boolean"}


def judge_lines(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """All rows with the counts of the rules, the share of content and the verdict.

    Null and empty texts have no words, so the base rules fail them; equal texts
    get equal verdicts; an empty table stays empty.  A result column whose name
    is taken gets underscores after it.
    """
    names = fresh(docs, *RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches):
        words, model = Words(), shared.value
        for batch in batches:
            rows = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                x = analyse(t, words)
                failed = x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words
                share = model.content_share(x)
                rows.append((x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, share,
                             not failed and share >= CONTENT_SHARE))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield extended(batch, 1, made)

    return mapped(docs, [whole_text(text)], run, dict(zip(names, RESULT.values(), strict=True)))
