import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hourcast.session import checkpoint_dir, get_session

    s = get_session("local[4]", app="hourcast-tests", **{"spark.sql.shuffle.partitions": "8"})
    checkpoint_dir(s)  # unset in tests: a scratch folder is registered
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="hourcast-test-")
