import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from sluice.runtime import session

    return session("tests", 4)
