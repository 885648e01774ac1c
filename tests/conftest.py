import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from guichet.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_broadcasts(monkeypatch):
    """Nothing counts as small: every join and order takes its distributed way."""
    from guichet.operators import settle

    monkeypatch.setattr(settle, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(settle, "SERIES_ROWS", 0)
