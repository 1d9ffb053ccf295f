import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quoin.runtime import local_session

    s = local_session(4, 4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield s
    s.stop()
