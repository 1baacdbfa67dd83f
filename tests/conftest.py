from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from labelproof.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 8, "12g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("input tables are not on this machine")
    return str(path)


@pytest.fixture(scope="session")
def oracle_connection(folder):
    import oracle

    return oracle.connect(folder)
