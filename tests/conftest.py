import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import session  # noqa: E402
from veil import Settings  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    spark = session("veil-tests", "4", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": folder,
        "spark.sql.files.openCostInBytes": "262144",
    })
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def settings():
    return Settings("s3cr3t-salt", "dr4w-key")


@pytest.fixture(scope="session")
def parity():
    return Settings("s3cr3t-salt", "dr4w-key", parity=True)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")
