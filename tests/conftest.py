import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from textcluster.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=4, app="textcluster-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(spark):
    from textcluster.session import scratch_path

    return scratch_path(spark, "test")
