import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tallyguard.session import local_session, shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=8, app="tests")
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
