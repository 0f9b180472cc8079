"""Toxicity of documents: a linear classifier whose scores hardly change when identity terms are swapped.

Features are a document's distinct words and the beginnings of words (hashed);
the ones kept differ most between the labels.  Every labelled sentence that names
a group is read again with each other name of its kind in place of that name, and
the squared change of the sentence's score is a penalty in training.  What the
other words of the sentence have in common with either name does not change, so
it is no part of the penalty.  So a name that happens to stand in toxic documents
does not make a neutral mention toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veil.llm.rows import Words, hash64, whole_text
from veil.llm.training import logistic, training_rows, with_scores
from veil.operators.materialize import materialize

#: Names of groups by kind; names of one kind are swapped for each other.
IDENTITY_TERMS = {
    "gender": ["women", "men", "woman", "man", "girls", "boys", "transgender", "nonbinary"],
    "religion": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish"],
    "origin": ["immigrants", "foreigners", "refugees", "mexicans", "africans", "asians", "europeans", "arabs"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer"],
    "colour": ["black", "white", "brown"],
    "age": ["elderly", "teenagers", "children", "adults"],
    "gender_de": ["frauen", "männer", "mädchen", "jungen"],
    "origin_de": ["ausländer", "einwanderer", "flüchtlinge", "türken", "deutsche", "polen"],
    "religion_de": ["muslime", "christen", "juden", "atheisten"],
    "gender_fr": ["femmes", "hommes", "filles", "garçons"],
    "origin_fr": ["étrangers", "immigrés", "réfugiés", "arabes", "africains", "français"],
    "religion_fr": ["musulmans", "chrétiens", "juifs", "athées"],
    "gender_es": ["mujeres", "hombres", "chicas", "chicos"],
    "origin_es": ["extranjeros", "inmigrantes", "refugiados", "gitanos", "españoles"],
    "religion_es": ["musulmanes", "cristianos", "judíos", "ateos"],
}
_KIND = {term: kind for kind, terms in IDENTITY_TERMS.items() for term in terms}
#: Labelled documents learned from, and features kept.
MOST_ROWS, MOST_FEATURES = 16_000, 1024
#: A feature stands in so many labelled documents at least, and its share of ones is off by so many deviations.
LEAST_DOCS, LEAST_DEVIATIONS = 5, 4.0
#: Weights of the penalties: squares of the weights, and squared changes of scores by swaps.
RIDGE, SWAP = 0.1, 4.0
#: Lengths of the beginnings of words that are features.
STARTS = (3, 4, 5)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, as signed 64-bit numbers."""
    names = [f"w {word}"] + [f"{n} {word[:n]}" for n in STARTS if len(word) > n]
    return tuple(h - (1 << 64) if (h := hash64(n)) >> 63 else h for n in names)


class _Features:
    def __init__(self, known: dict[int, int] | None = None):
        """``known``: places of the features that count; without it all do."""
        if known is None:
            self._of = Words(features)
        else:
            self._of = Words(lambda w: tuple(known[f] for f in features(w) if f in known))

    def of(self, text: str) -> set[int]:
        get = self._of.__getitem__
        return {f for w in set(_WORD.findall(text.lower())) for f in get(w)}


def swapped(sentence: str) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each identity term in a sentence and each other term of its kind: the features that come and those that go."""
    words = set(_WORD.findall(sentence))
    out = []
    for term in sorted(_KIND.keys() & words):
        old = {f for w in words for f in features(w)}
        for other in IDENTITY_TERMS[_KIND[term]]:
            if other != term:
                new = {f for w in (words - {term}) | {other} for f in features(w)}
                out.append((tuple(sorted(new - old)), tuple(sorted(old - new))))
    return out


def _statistics(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per feature, documents and toxic ones; and the swaps of labelled sentences, equal ones counted together."""

    def count(batches):
        make = _Features()
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            found = [np.fromiter(s, dtype=np.int64, count=len(s)) for s in map(make.of, batch.column(0).to_pylist())]
            flat = np.concatenate(found)
            ids, place = np.unique(flat, return_inverse=True)
            toxic = np.bincount(place, weights=np.repeat(label, [len(f) for f in found]), minlength=len(ids))
            docs = np.bincount(place, minlength=len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(docs.astype(np.int64)), pa.array(toxic.astype(np.int64))],
                ["feature", "docs", "toxic"])

    def swap(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for sentence in _SENTENCE.split(text.lower()):
                    seen.update(swapped(sentence))
            yield pa.RecordBatch.from_arrays(
                [pa.array([come for come, _ in seen], kind), pa.array([go for _, go in seen], kind),
                 pa.array(list(seen.values()), pa.int64())], ["come", "go", "sentences"])

    counted = rows.mapInArrow(count, "feature bigint, docs bigint, toxic bigint").groupBy("feature").agg(
        F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    swaps = rows.mapInArrow(swap, "come array<bigint>, go array<bigint>, sentences bigint").groupBy("come", "go").agg(
        F.sum("sentences").alias("sentences"))
    return counted, swaps


@dataclass
class ToxicityModel:
    known: dict[int, int]
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str], make: _Features) -> np.ndarray:
        return logistic(np.array([self.bias + sum(self.weights[f] for f in make.of(t)) for t in texts]))


def swap_penalty(found: list[tuple], known: dict[int, int]) -> np.ndarray:
    """The sum of squared changes of scores as a matrix over the weights.

    ``found`` are (features that come, features that go, sentences).  Each term
    is also swapped once in a sentence of its own, so that terms without any
    labelled sentence are held as well.
    """
    alone = [(come, go, 1) for term in _KIND for come, go in swapped(term)]
    total: Counter = Counter()
    for come, go, sentences in [*found, *alone]:
        # A feature that was not kept has no weight.
        total[tuple(known[f] for f in come if f in known), tuple(known[f] for f in go if f in known)] += sentences
    changes = np.zeros((len(total), len(known)))
    for row, (come, go) in zip(changes, total, strict=True):
        row[list(come)] += 1
        row[list(go)] -= 1
    return (changes.T * np.array(list(total.values()), dtype=np.float64)) @ changes


def train(x: np.ndarray, y: np.ndarray, times: np.ndarray, swaps: np.ndarray, swap: float = SWAP,
          ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Logistic regression with both penalties, by Newton's method; row ``i`` counts ``times[i]``."""
    rows, width = x.shape
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y[0] if rows else 0.0, 1e-3, 1 - 1e-3))
        return np.zeros(width), float(np.log(share / (1 - share)))
    wide = np.hstack([x, np.ones((rows, 1))])
    penalty = ridge * np.eye(width + 1)
    penalty[-1, -1] = 1e-6
    penalty[:-1, :-1] += swap * swaps
    w = np.zeros(width + 1)
    for _ in range(25):
        p = logistic(wide @ w)
        slope = wide.T @ (times * (p - y)) + penalty @ w
        curve = (wide.T * (times * np.maximum(p * (1 - p), 1e-6))) @ wide + penalty
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id",
                 text: str = "text", most: int = MOST_ROWS, swap: float = SWAP) -> ToxicityModel:
    """Learns from at most ``most`` labelled documents; ``swap`` weighs the penalty on swaps.

    An id that is labelled twice counts as 1 if one label does; of rows with the
    same id one is learned from.  Without labelled rows, or with one label only, every score is the share of ones.
    """
    rows = materialize(training_rows(docs, labels, label, most, doc_id, text))
    counted, changed = _statistics(rows)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    share = min(max(total["t"] / max(total["n"], 1), 1e-6), 1 - 1e-6)
    off = (F.col("toxic") - F.col("docs") * share) / F.sqrt(F.col("docs") * share * (1 - share))
    best = counted.filter(F.col("docs") >= LEAST_DOCS).withColumn("off", off).filter(
        F.abs("off") >= LEAST_DEVIATIONS).orderBy(F.abs("off").desc(), "feature").limit(MOST_FEATURES)
    known = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}
    for terms in IDENTITY_TERMS.values():
        for term in terms:
            for f in features(term):
                known.setdefault(f, len(known))

    def places(batches):
        make = _Features(known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(make.of(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())),
                 batch.column(1)], ["places", "label"])

    got = rows.mapInArrow(places, "places array<int>, label int").groupBy("places", "label").count().toPandas()
    got["places"] = [tuple(int(i) for i in p) for p in got["places"]]
    got = got.sort_values(["places", "label"])
    x = np.zeros((len(got), len(known)), dtype=np.float64)
    for i, found in enumerate(got["places"]):
        x[i, list(found)] = 1
    times = got["count"].to_numpy(dtype=np.int64)
    # Swaps of at most ``most`` documents, equal ones together.
    penalty = swap_penalty([(r["come"], r["go"], r["sentences"]) for r in changed.collect()], known)
    # Only features that occur or are swapped have a say; the others keep the weight 0.
    used = np.flatnonzero(x.any(axis=0) | (penalty != 0).any(axis=0))
    weights = np.zeros(len(known))
    weights[used], bias = train(x[:, used], got["label"].to_numpy(dtype=np.float64), times,
                                penalty[np.ix_(used, used)], swap)
    return ToxicityModel(known, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """All rows with the probability that the label is 1.

    An empty or null text has no features, so it gets the score of the bias;
    equal texts get equal scores; an empty table stays empty; a column named
    ``out`` is kept and the score gets underscores after its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        make = _Features(shared.value.known)
        return lambda texts: shared.value.score(texts, make)

    return with_scores(docs, text, scorer, out)
