import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from contigloom.session import local_session

    s = local_session("4", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tiled(monkeypatch):
    """Small tiles, so that carries cross them on small inputs as well."""
    from contigloom.operators import tiled as module

    monkeypatch.setattr(module, "TILE_BITS", 3)
