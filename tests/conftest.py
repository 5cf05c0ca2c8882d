import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    s = session("tests", cores=8, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield s
    s.stop()
