import pandas as pd
import pytest

from phrasedex.llm.common import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def small_docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with other columns of clashing names."""

    def make(rows):
        wide = [(i, t, "x", None, 1, 2) for i, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, block string, source string, size int, key int")

    return make
