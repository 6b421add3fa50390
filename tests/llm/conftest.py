"""Session and small tables for the training-data operators."""

import pytest
from pyspark.sql import SparkSession

from salespark.llm import common

EDGE_TEXTS = [None, "", " \t\n", "a", "one two", "é 🙂 日本語", "the same line\n" * 30, "word " * 5000]


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("llm-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    common.ship(session)
    yield session


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows, extra columns
    whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id"), (None, None), (3, "a"), (4, "other text")]
    return spark.createDataFrame([(*r, "x", 1.0, 7, "y") for r in rows],
                                 "doc_id long, text string, fp string, score double, w int, t string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
