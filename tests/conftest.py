import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cairntrace.operators.ordered import release  # noqa: E402
from cairntrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _drop_persisted():
    yield
    release()
