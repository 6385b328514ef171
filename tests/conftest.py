import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quartier.session import local_session

    session = local_session(8, "quartier-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture
def spread_path(monkeypatch):
    """Force the paths meant for large inputs: distributed ranks and split lookups."""
    from quartier.operators import lookup, quantiles, ranks

    monkeypatch.setattr(quantiles, "EXACT_ROWS", 0)
    monkeypatch.setattr(quantiles, "MIN_BUCKETS", 8)
    monkeypatch.setattr(quantiles, "MAX_BUCKETS", 16)
    monkeypatch.setattr(ranks, "EXACT_ROWS", 0)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 2)
