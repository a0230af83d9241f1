"""Date expressions. Year selection is written as a half-open range so that Catalyst
pushes it into the Parquet scan (``year(col) = Y`` would stay a residual filter)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_year(date_col: str | Column, year: int) -> Column:
    c = _col(date_col)
    return (c >= F.lit(dt.date(year, 1, 1))) & (c < F.lit(dt.date(year + 1, 1, 1)))


def in_years(date_col: str | Column, first_year: int, last_year: int) -> Column:
    c = _col(date_col)
    return (c >= F.lit(dt.date(first_year, 1, 1))) & (c < F.lit(dt.date(last_year + 1, 1, 1)))


def month_of(date_col: str | Column) -> Column:
    """Calendar month 1..12 (years collapse, as in the monthly analyses)."""
    return F.month(_col(date_col))


def year_month(date_col: str | Column) -> Column:
    """'YYYY-MM' label of a date."""
    return F.date_format(_col(date_col), "yyyy-MM")


def day_gap(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from ``earlier`` to ``later``."""
    return F.datediff(_col(later), _col(earlier))
