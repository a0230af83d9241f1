"""Distinct households and retailers from sketches, one a month, that merge to any range.

An exact distinct count over a range of months can't be put together from the months' counts,
since a household shops in several; it has to read all trips of the range. Sketches can: each
holds at most 2^lg_k small registers whatever the trips, and the union of two is the sketch of
both. Exact counts (``profile``) stay the default.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12  # 2^12 registers, 4 KiB a sketch
_SKETCHES = ("households", "retailers")


def relative_error(lg_k: int = LG_K) -> float:
    """The standard error of an estimate, as a share of the exact count."""
    return 1.04 / 2 ** (lg_k / 2)


def month_sketches(trips: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(month, households, retailers): the sketches of each calendar month, named by its first
    day; trips without a date have the month NULL. NULL ids count nowhere. Sketches are
    combined map-side, so a month is one row a task in the shuffle."""
    sketch = [F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(name) for name, c in zip(_SKETCHES, ("hh_id", "tc_retailer_code"), strict=True)]
    return trips.groupBy(F.trunc("tc_date", "MM").alias("month")).agg(*sketch)


def _union() -> list[Column]:
    return [F.hll_union_agg(c).alias(c) for c in _SKETCHES]


def merge_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sketches of the trips of both; a trip in both counts once."""
    return a.unionByName(b).groupBy("month").agg(*_union())


def approx_distinct(sketches: DataFrame, first: dt.date | None = None, last: dt.date | None = None, by: Column | None = None) -> DataFrame:
    """(n_households, n_retailers), estimated, over the months that begin from ``first`` to
    ``last`` (both included; None: open, and with both open the trips without a date too), in
    one row or one per ``by``, an expression of ``month``."""
    if first is not None:
        sketches = sketches.filter(F.col("month") >= F.lit(first))
    if last is not None:
        sketches = sketches.filter(F.col("month") <= F.lit(last))
    merged = (sketches.groupBy(by) if by is not None else sketches.groupBy()).agg(*_union())
    counts = [F.hll_sketch_estimate(c).alias(f"n_{c}") for c in _SKETCHES]
    return merged.select(*[c for c in merged.columns if c not in _SKETCHES], *counts)


def _quarter(date: str) -> Column:
    return F.concat(F.year(date), F.lit("-Q"), F.quarter(date)).alias("quarter")


def distinct_by_quarter(trips: DataFrame, lg_k: int = LG_K, errors: float = 5.0) -> DataFrame:
    """(quarter, n_households, n_retailers, households_close, retailers_close): the exact counts
    of each quarter, and whether the estimates that the months' sketches give are within
    ``errors`` standard errors of them. Trips without a date are left out."""
    dated = trips.filter(F.col("tc_date").isNotNull())
    exact = dated.groupBy(_quarter("tc_date")).agg(
        F.countDistinct("hh_id").alias("n_households"), F.countDistinct("tc_retailer_code").alias("n_retailers")
    )
    guess = approx_distinct(month_sketches(dated, lg_k), by=_quarter("month"))
    bound = F.lit(errors * relative_error(lg_k))
    close = [(F.abs(F.col(f"g.n_{c}") - F.col(f"e.n_{c}")) <= bound * F.col(f"e.n_{c}")).alias(f"{c}_close") for c in _SKETCHES]
    return exact.alias("e").join(guess.alias("g"), F.col("e.quarter") == F.col("g.quarter")).select("e.*", *close)
