from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.session import build_session, checkpoint_dir  # noqa: E402
from tillroll.sources.panel import Panel  # noqa: E402
from tillroll.sources.schema import SCHEMAS  # noqa: E402

SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="tillroll-tests")
    if not checkpoint_dir(s):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-tests-"))
    yield s
    s.stop()


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def m(text: str | float | int) -> Decimal:
    return Decimal(str(text)).quantize(Decimal("0.01"))


def make_panel(spark, households=(), products=(), trips=(), purchases=()) -> Panel:
    """A panel from row tuples in schema column order (see tillroll.sources.schema)."""
    frames = {}
    for name, rows in (("households", households), ("products", products), ("trips", trips), ("purchases", purchases)):
        frames[name] = spark.createDataFrame(list(rows), SCHEMAS[name])
    return Panel(**frames)
