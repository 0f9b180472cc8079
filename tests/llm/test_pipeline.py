"""The pipeline on small tables, and what is registered."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_duplicates import brute_classes, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == first.columns, name
        assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in docs.collect()}
        docs = after
    bench = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    parts = {tuple(b[i:i + 13]) for b in bench for i in range(len(b) - 12)}
    texts = [r["text"] for r in docs.collect()]
    assert texts and len(set(texts)) == len(texts)
    for words in (re.findall(r"\w+", t.lower()) for t in texts):
        assert not any(tuple(words[i:i + 13]) in parts for i in range(len(words) - 12))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and out.filter("NOT round_trip").count() == 0


def test_token_ids_take_one_python_worker_for_a_task(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.token_ids(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


CLASHING = {"pipeline_score": "9", "pipeline_deleted": "9", "n_items": "9", "longest": "9", "ids": "9", "bytes": "9",
            "score": "9", "at": "9", "a.b": "9"}


def test_stages_leave_other_columns_alone(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain, clashing = docs, docs.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, clashing = stage(spark, plain, SF), stage(spark, clashing, SF)
        assert clashing.columns == [*plain.columns, *CLASHING], name
        rows = {r["doc_id"]: r for r in clashing.collect()}
        assert {k: (r["text"], r["n_chars"]) for k, r in rows.items()} == {
            r["doc_id"]: (r["text"], r["n_chars"]) for r in plain.collect()}, name
        assert all(r[k] == v for r in rows.values() for k, v in CLASHING.items())
    done = corpus_pipeline.token_ids(spark, clashing, SF)
    assert done.filter("NOT round_trip").count() == 0 and done.count() == plain.count()


def test_stages_take_nulls_and_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, None, None, "s", None),
                                 (-3, " \n\t\n ", "de", "s", 5)], docs.schema)
    mixed, empty = docs.limit(40).unionByName(odd).unionByName(odd), docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        mixed, empty = stage(spark, mixed, SF), stage(spark, empty, SF)
        assert empty.count() == 0 and mixed.count() > 0, name
    assert mixed.filter("NOT round_trip").count() == 0


def test_what_is_left_of_a_copy_goes_if_it_is_blank(spark):
    line = "This is a line of text that is long enough to be a block by itself."
    rows = [(1, f"{line}\nown words of one"), (2, f"\n{line}\n \n"), (3, f"{line}\nrest"), (4, "\n \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.new_lines(spark, docs, SF).collect()}
    assert left == {1: (rows[0][1], len(rows[0][1])), 3: ("rest", 4), 4: ("\n \n", 3)}


def test_stages_against_plain_versions(spark):
    """Line by line and pair by pair what two stages keep; the others have their own tests."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 2 = 0")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.new_lines(spark, docs, SF).collect()}
    lost = brute_lines([(i, t) for t, i in sorted(first.items(), key=lambda x: x[1])])
    for i, t in rows:
        if first[t] != i:
            assert i not in kept or not t
        elif not lost[i]:
            assert kept[i] == t
        else:
            assert i not in kept or len(kept[i].split("\n")) <= len(t.split("\n")) - lost[i]
    classes = {class_id for _, class_id, _ in brute_classes(rows)}
    assert {r["doc_id"] for r in corpus_pipeline.distinct_documents(spark, docs, SF).collect()} == classes
