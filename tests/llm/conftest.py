import os
import sys

import pytest
from pyspark.sql import functions as F

from tiercraft.llm.text import ship

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import AWKWARD, EXTRA, SCHEMA  # noqa: E402

@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False, parts=3):
        rows = [tuple(r) + ("en", "s", 0)[len(r) - 2:] for r in rows]
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        if extra:
            for c in EXTRA:
                df = df.withColumn(c, F.lit("x"))
        return df
    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    return docs_of(AWKWARD, extra=True)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([], extra=True)
