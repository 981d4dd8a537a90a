import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    ckpt = tempfile.mkdtemp(prefix="lexspark-test-ckpt-", dir="/tmp")
    s = (SparkSession.builder.master("local[*]")
         .appName("lexspark-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from lexspark.session import get_session
    get_session()
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="lexspark-test-", dir="/tmp")


def docs_df(spark, rows, key_type="string"):
    return spark.createDataFrame(rows, f"doc_key {key_type}, text string")
