import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from parcelry.session import build_session, checkpoint_dir

    s = build_session("local[4]", shuffle_partitions=4)
    checkpoint_dir(s)  # tests run local: a scratch folder is registered only when unset
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
