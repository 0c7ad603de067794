from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "gridcast-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def hourly(start: str, values, station: str = "A", source: str = "s1", step: int = 1):
    """(source, station, time, value) rows, one per step."""
    first = ts(start)
    return [(source, station, first + timedelta(hours=step * i), None if v is None else float(v)) for i, v in enumerate(values)]


PANEL = "source string, station_id string, timestamp_utc timestamp, temperature_c double"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=PANEL):
        return spark.createDataFrame(rows, schema)

    return make
