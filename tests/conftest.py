from __future__ import annotations

import os
import sys
from datetime import date

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
TABLES = "/root/testdata/sf0.01"  # the tables that registered queries are compared on


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session, ship

    s = build_session("tests", "8", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


def day(n: int) -> date:
    return date.fromordinal(date(2020, 1, 1).toordinal() + n)
