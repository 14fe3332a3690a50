import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowmend.session import get_spark, release_kept  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark("8", "tests")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _release():
    yield
    release_kept()


@pytest.fixture(scope="session")
def sf():
    return SF
