import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from cadenza.session import local_session

    s = local_session("tests", "8", shuffle=4)
    yield s
    s.stop()
