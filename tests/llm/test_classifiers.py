"""Toxicity, quality and line labels: held-out accuracy and the methods' own properties."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.llm import line_labels, quality, toxicity
from veil.llm.training import held_out, training_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def known(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def accuracy(scored, labels, label, threshold):
    rows = scored.join(labels, "doc_id").filter(held_out(F.col("doc_id"))).select(
        (F.col("score") >= threshold).cast("int").alias("p"), F.col(label).alias("y")).collect()
    return sum(r["p"] == r["y"] for r in rows) / len(rows), sum(r["p"] > r["y"] for r in rows)


def test_quality_of_held_out_documents(known, labels):
    model = quality.fit_quality(known, labels)
    right, _ = accuracy(quality.score_quality(known, model), labels, "quality", 0.5)
    assert right >= 0.95 and 0.5 <= model.temperature <= 8


def test_toxicity_of_held_out_documents(known, labels):
    model = toxicity.fit_toxicity(known, labels)
    right, wrong = accuracy(toxicity.score_toxicity(known, model), labels, "toxic", 0.7)
    assert right >= 0.9 and wrong == 0


def test_held_out_ids(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_the_bound_is_one_of_rows(spark):
    """An id in hundreds of rows is one row to learn from."""
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(700)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id bigint, toxic int")
    for most in (2, 100):
        rows = training_rows(docs, labels, "toxic", most).collect()
        assert 0 < len(rows) <= min(most, 7) and all(int(r["text"][5:]) % 7 % 2 == r["label"] for r in rows)


def test_swapped_terms_change_scores_little(spark):
    """A group's name stands in toxic texts only; the penalty keeps a neutral mention clean."""
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = f"the women here are scum {i}" if bad else f"a fine day for a walk with number {i}"
        rows.append((i, text))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    neutral = ["women work in this house", "men work in this house"]

    def gap(swap):
        model = toxicity.fit_toxicity(docs, truth, swap=swap)
        make = toxicity._Features(model.known)
        scores = model.score([*neutral, "they are scum"], make)
        return abs(scores[0] - scores[1]), scores

    free, held = gap(0.0)[0], gap(100.0)
    assert free > 0.05 and held[0] < free / 5 and held[1][2] > held[1][0]


SENTENCES = ["the women here met the men", "Women, women and a girl.", "muslims like muslim food", "no group at all", "",
             "the man who saw black and white", "womenfolk and women", "ausländer und einwanderer und ausländisch"]


def test_the_penalty_is_that_of_swapped_sentences():
    """Scores of sentences written out with each other term, against the matrix."""
    terms = {t: (kind, ts) for kind, ts in toxicity.IDENTITY_TERMS.items() for t in ts}
    texts = [*SENTENCES, *terms]
    known: dict = {}
    for text in texts:
        for word in [*re.findall(r"\w+", text.lower()), *terms]:
            for f in toxicity.features(word):
                known.setdefault(f, len(known))
    weights = np.random.default_rng(1).normal(size=len(known))
    make = toxicity._Features(known)

    def score(words):
        return sum(weights[f] for f in make.of(" ".join(words)))

    wanted = 0.0
    for text in texts:
        words = re.findall(r"\w+", text.lower())
        for term in set(words) & set(terms):
            for other in terms[term][1]:
                if other != term:
                    wanted += (score([other if w == term else w for w in words]) - score(words)) ** 2
    found = [(come, go, 1) for s in SENTENCES for come, go in toxicity.swapped(s.lower())]
    got = weights @ toxicity.swap_penalty(found, known) @ weights
    assert got == pytest.approx(wanted) and len(found) > 20


def test_neutral_mentions_of_every_term_are_clean(known, labels):
    model = toxicity.fit_toxicity(known, labels)
    terms = [t for ts in toxicity.IDENTITY_TERMS.values() for t in ts]
    texts = [f"{a} {t} {b}" for t in terms for a, b in (("many", "live in this town"), ("we met", "at school"), ("", ""))]
    assert (model.score(texts, toxicity._Features(model.known)) < 0.7).all()


def test_the_penalty_lowers_false_alarms(spark):
    """Groups named in toxic texts alone: without the penalty their names alone raise a score, with it they do not."""
    kinds = [ts for ts in toxicity.IDENTITY_TERMS.values() if len(ts) > 3]
    named = [ts[0] for ts in kinds]
    rows = [(i, f"{named[i % len(named)]} {['scum', 'idiots', 'trash'][i % 3]} {i}" if i % 2 else f"a fine day {i}")
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")

    def gaps(swap):
        model = toxicity.fit_toxicity(docs, truth, swap=swap)
        make = toxicity._Features(model.known)
        named_scores, others = (model.score([f"{ts[i]} work here" for ts in kinds], make) for i in (0, 2))
        return np.abs(named_scores - others).max(), model.score(["idiots", "scum", "trash"], make).min()

    free, held = gaps(0.0), gaps(toxicity.SWAP)
    assert held[0] < free[0] / 5 and held[1] >= 0.7


def test_one_label_or_none(spark, known, edges, nothing, clashing):
    for truth in ([], [(1, 1), (8, 1), (3, 1)]):
        labels = spark.createDataFrame(truth, "doc_id bigint, quality int").withColumn("toxic", F.col("quality"))
        for fit, score in ((quality.fit_quality, quality.score_quality),
                           (toxicity.fit_toxicity, toxicity.score_toxicity)):
            model = fit(edges, labels)
            rows = score(edges, model).collect()
            assert len(rows) == edges.count() and len({round(r["score"], 9) for r in rows}) == 1
            assert 0 <= rows[0]["score"] <= 1
            assert score(nothing, model).count() == 0
            assert score(clashing, model).columns == [*clashing.columns, "score_"]
        field = line_labels.fit_lines(edges, labels)
        assert line_labels.judge_lines(nothing, field).count() == 0
        out = line_labels.judge_lines(clashing, field)
        assert out.columns[-8:-6] == ["n_words_", "word_chars"] and out.count() == edges.count()


def python_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i:i + 5]), []).append(i)
    again = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(again), failed)


def test_rules_by_brute_force(known, edges, labels):
    field = line_labels.fit_lines(known, labels)
    for table in (known, edges):
        for r in line_labels.judge_lines(table, field).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                    r["base_failed"]) == python_rules(r["text"])
            assert r["kept"] == (not r["base_failed"] and r["content_share"] >= line_labels.CONTENT_SHARE)


def test_viterbi_finds_the_best_sequence():
    draw = np.random.default_rng(3)
    for _ in range(50):
        field = line_labels.Field(draw.normal(size=line_labels.FEATURES), draw.normal(size=(2, 2)))
        x = draw.normal(size=(6, line_labels.FEATURES))

        def worth(labels, x=x, field=field):
            return sum(labels[i] * (x[i] @ field.weights) for i in range(6)) + sum(
                field.steps[labels[i], labels[i + 1]] for i in range(5))

        best = max(worth([n >> i & 1 for i in range(6)]) for n in range(64))
        assert worth(field.best(x).tolist()) == pytest.approx(best)


def test_training_learns_runs():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(1, 1, (40, 8, line_labels.FEATURES)), draw.normal(-1, 1, (40, 8, line_labels.FEATURES))
    runs, kinds = [*good, *bad], np.array([1] * 40 + [0] * 40)
    field = line_labels.train(*line_labels.mosaics(runs, kinds))
    assert field.steps[1, 1] + field.steps[0, 0] > field.steps[0, 1] + field.steps[1, 0]
    assert np.mean([field.best(r).mean() for r in good]) > 0.9 > 0.1 > np.mean([field.best(r).mean() for r in bad])
