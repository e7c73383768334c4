import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohorte.session import get_session

    ckpt = tempfile.mkdtemp(prefix="cohorte-test-ckpt-")
    s = get_session("local[*]", shuffle_partitions=8, extra_conf={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    return tempfile.mkdtemp(prefix="cohorte-test-")
