import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palaver.session import session

    folder = tmp_path_factory.mktemp("checkpoints")
    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{folder}")
    yield s
    s.stop()
