import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sitewatt.session import get_session
    s = get_session("local[*]", 8)
    if not s.conf.get("spark.checkpoint.dir", None):  # tests only: a scratch checkpoint folder
        d = tempfile.mkdtemp(prefix="sitewatt-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="sitewatt-test-")
