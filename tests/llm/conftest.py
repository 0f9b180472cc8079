import pytest

EDGES = [
    (1, "One two three four five six seven eight nine ten.\nA second line that is long enough to count here."),
    (1, "One two three four five six seven eight nine ten.\nA second line that is long enough to count here."),
    (2, None), (3, ""), (None, "no id at all but some words to look at"), (None, None), (4, " \n\t \n"),
    (5, "word " * 30000), (6, "a" * 5000), (7, "é\u0000ß \U0001f600 x\r\ny"),
    (8, "One two three four five six seven eight nine ten.\nA second line that is long enough to count here."),
]
#: Names that the operators use themselves, and one with a dot.
CLASHES = {"score": "9", "ids": "9", "at": "9", "root": "9", "kept": "9", "n_items": "9", "a.b": "9", "whole_text": "9",
           "n_bytes": "9", "runs": "9", "held": "9", "n_deleted": "9", "n_replaced": "9", "n_words": "9"}


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, edges):
    from pyspark.sql import functions as F

    return edges.select("*", *[F.lit(v).alias(k) for k, v in CLASHES.items()])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
