import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC"))
    session = builder.getOrCreate()
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bed(spark):
    return spark.createDataFrame(
        [("chr1", 0, 10, "a", ".", "+"), ("chr1", 20, 30, "b", ".", "+"), ("chr1", 30, 40, "c", ".", "-"),
         ("chr2", 0, 10, "d", ".", "+"), ("chr2", 10, 20, "e", ".", "-"), ("chr3", 0, 10, "f", ".", "+")],
        "chrom string, chromStart long, chromEnd long, name string, score string, strand string")
