import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sparkprep.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, app_name="sparkprep-tests")
    yield s


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet")
