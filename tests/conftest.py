import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from scenestream import session as S  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = S.local_session("4", partitions=4, memory="8g")
    yield s
    s.stop()


@pytest.fixture
def short_slices(spark):
    """Slices of a few seconds, so that every key crosses many."""
    spark.conf.set(S.SLICE_KEY, "3000")
    yield spark
    spark.conf.set(S.SLICE_KEY, str(S.DEFAULT_SLICE_MS))


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
