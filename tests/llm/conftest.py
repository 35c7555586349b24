from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm_spark(spark, tmp_path_factory):
    """The shared session, with a folder for written tables."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def small_docs(llm_spark):
    return llm_spark.read.parquet(os.path.join(SMALL, "documents.parquet"))
