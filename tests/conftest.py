import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from chronolake import session

    made = session.local_session(os.environ.get("TEST_CPUS", "4"), spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield made
    made.stop()


@pytest.fixture
def root():
    with tempfile.TemporaryDirectory() as path:
        yield path


@pytest.fixture
def engine(spark, root):
    from chronolake.engine import Engine

    return Engine(spark, root, "v3_enterprise")
