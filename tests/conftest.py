import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("subrecon-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="subrecon-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.exists(os.path.join(SF_SMALL, "lineitem.parquet")):
        pytest.skip("driver test data not present")
    return SF_SMALL


@pytest.fixture(scope="session")
def fixture_rec(spark, sf_small):
    from subrecon.plans.analysis import Reconciliation
    from subrecon.sources.fixtures import fixture_evidence

    return lambda: Reconciliation(fixture_evidence(spark, sf_small))
