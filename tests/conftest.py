import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from treeline.session import DEFAULTS, ship_package

    ck = tempfile.mkdtemp(prefix="treeline-test-ckpt-")
    b = (SparkSession.builder.master("local[4]").appName("treeline-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", ck))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ck)
    ship_package(s)
    yield s
    s.stop()


SMOKE = "/root/testdata/sf0.001"
