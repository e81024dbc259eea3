import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master(os.environ.get("ROADLENS_TEST_MASTER", "local[*]")).appName("roadlens-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="roadlens-test-ckpt-", dir="/tmp")
        s.conf.set("spark.checkpoint.dir", d)
    s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir"))
    from roadlens.session import ship_package
    ship_package(s)
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
