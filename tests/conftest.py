"""One local session for all tests, with the package on the workers."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sievefold.session import local_session, ship

    session = local_session(cores="4", partitions=4, memory="6g")
    ship(session)
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
