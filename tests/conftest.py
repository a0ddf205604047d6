import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from flowsentry.session import get_spark
    s = get_spark(master="local[*]")
    s.conf.set("spark.sql.shuffle.partitions", "8")
    yield s
    s.stop()
