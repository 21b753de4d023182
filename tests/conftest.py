import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from murmur.session import get_spark
    ck = tempfile.mkdtemp(prefix="murmur-test-ckpt-")
    s = get_spark("local[4]", 8, extra={"spark.checkpoint.dir": ck, "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SMALL
