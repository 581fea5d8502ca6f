from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickertide.session import ROCKSDB_PROVIDER, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tickertide-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.maxMetadataStringLength": "2000",  # plan tests read all filters
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def at():
    """Build a moment of 2024-01-01 from 'HH:MM[:SS[.ffffff]]'."""

    def make(clock: str) -> datetime:
        return datetime.fromisoformat(f"2024-01-01T{clock}")

    return make
