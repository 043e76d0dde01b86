from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attesta.session import build_session, name_local_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]")
    session.sparkContext.setLogLevel("ERROR")
    name_local_folder(session)
    yield session
    session.stop()
