import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from dialogscope.config import build_session, scratch_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app="dialogscope-tests", shuffle_partitions=8)
    scratch_dir(s)  # tests run without a cluster checkpoint folder: use a fresh temp one
    yield s
    s.stop()
