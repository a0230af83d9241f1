"""Gaps between shopping trips and inactive households."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import day_gap
from tillroll.functions.stats import ratio
from tillroll.operators.profile import trips_in_year
from tillroll.operators.sequence import sequence_number
from tillroll.sources.schema import DAYS_PER_MONTH, INACTIVE_MONTHS


def trip_sequence(
    trips: DataFrame, year: int | None = None, by: str = "date", num_slices: int | None = None
) -> DataFrame:
    """Number the trips 1..n: ``by="date"`` orders by (date, trip id); ``by="household"``
    by (household, date, trip id). Output (hh_id, tc_date, tc_id, id)."""
    t = trips_in_year(trips, year).select("hh_id", "tc_date", "tc_id")
    order = ["tc_date", "tc_id"] if by == "date" else ["hh_id", "tc_date", "tc_id"]
    return sequence_number(t, order, "id", num_slices)


def _placed(trips: DataFrame, year: int | None) -> DataFrame:
    """The trips that have a place in their household's sequence: those with a household,
    a date and an id."""
    t = trips_in_year(trips, year).select("hh_id", "tc_date", "tc_id")
    return t.filter(F.col("hh_id").isNotNull() & F.col("tc_date").isNotNull() & F.col("tc_id").isNotNull())


def next_trip_pairs(trips: DataFrame, year: int | None = None) -> DataFrame:
    """Each trip with the same household's next trip (by date, then trip id) and the gap
    in days. Output (hh_id_0, tc_date_0, tc_id_0, hh_id_1, tc_date_1, tc_id_1, time_window).
    Trips without a household, a date or an id have no place in a sequence and are skipped.

    Neighbours on one day come from a window over the household's day; the last trip of a
    day is followed by the first one of the household's next day, which a window over one
    row per household and day finds (bounded by the calendar). A household with very many
    trips is thus spread over its days."""
    t = _placed(trips, year)
    day = Window.partitionBy("hh_id", "tc_date").orderBy("tc_id")
    same_day = t.withColumn("_next", F.lead("tc_id").over(day)).filter(F.col("_next").isNotNull()).select(
        "hh_id", "tc_date", F.col("tc_id").alias("_this"), F.col("tc_date").alias("_next_date"), "_next"
    )
    days = t.groupBy("hh_id", "tc_date").agg(F.min("tc_id").alias("_first"), F.max("tc_id").alias("_this"))
    household = Window.partitionBy("hh_id").orderBy("tc_date")
    next_day = days.select(
        "hh_id", "tc_date", "_this",
        F.lead("tc_date").over(household).alias("_next_date"), F.lead("_first").over(household).alias("_next"),
    ).filter(F.col("_next").isNotNull())
    return same_day.unionByName(next_day).select(
        F.col("hh_id").alias("hh_id_0"),
        F.col("tc_date").alias("tc_date_0"),
        F.col("_this").alias("tc_id_0"),
        F.col("hh_id").alias("hh_id_1"),
        F.col("_next_date").alias("tc_date_1"),
        F.col("_next").alias("tc_id_1"),
        day_gap("_next_date", "tc_date").alias("time_window"),
    )


def household_gaps(trips: DataFrame, year: int | None = None) -> DataFrame:
    """Gaps between a household's consecutive trips, counted: (hh_id, time_window, n).
    Trips of one day are 0 days apart; the window holds one row per household and day."""
    days = _placed(trips, year).groupBy("hh_id", "tc_date").agg(F.count(F.lit(1)).alias("_trips"))
    household = Window.partitionBy("hh_id").orderBy("tc_date")
    ahead = days.select("hh_id", "_trips", day_gap(F.lead("tc_date").over(household), "tc_date").alias("_gap"))
    gaps = F.array(
        F.struct(F.col("_gap").alias("time_window"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(0).alias("time_window"), (F.col("_trips") - 1).alias("n")),
    )
    return (
        ahead.select("hh_id", F.explode(gaps).alias("_g"))
        .select("hh_id", "_g.time_window", "_g.n")
        .filter(F.col("time_window").isNotNull() & (F.col("n") > 0))
    )


def inactive_gap_count(
    gaps: DataFrame, months: int = INACTIVE_MONTHS, days_per_month: int = DAYS_PER_MONTH
) -> DataFrame:
    """From ``household_gaps``: gaps longer than ``months`` months of ``days_per_month`` days
    (gap/30 > 3, i.e. more than 90 days), and the number of households with such a gap."""
    long_gaps = gaps.filter(F.col("time_window") > months * days_per_month)
    # per household first (combined map-side), then one row: no distinct-aggregate Expand
    per_household = long_gaps.groupBy("hh_id").agg(F.sum("n").alias("_n"))
    return per_household.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("gaps"), F.count(F.lit(1)).alias("households")
    )


def global_gap_count(trips: DataFrame, year: int | None = None, days: int = INACTIVE_MONTHS * DAYS_PER_MONTH) -> DataFrame:
    """Gaps of more than ``days`` days between neighbouring trips of *any* households, trips
    ordered by date alone. Neighbours on the same day have gap 0, so (for ``days`` >= 0)
    only consecutive distinct dates matter: the window runs over the distinct dates
    (bounded by the calendar, not by the data volume)."""
    dates = trips_in_year(trips, year).filter(F.col("tc_date").isNotNull()).select("tc_date").distinct()
    w = Window.orderBy("tc_date")
    gaps = dates.select(day_gap(F.lead("tc_date").over(w), F.col("tc_date")).alias("gap"))
    return gaps.agg(F.count(F.when(F.col("gap") > days, 1)).alias("gaps"))


def avg_gap_per_household(trips: DataFrame, year: int | None = None) -> DataFrame:
    """Mean days between consecutive trips of each household with two trips at least:
    (household, days). Consecutive gaps add up to the days from the first to the last trip,
    so one aggregation gives the mean."""
    span = _placed(trips, year).groupBy("hh_id").agg(
        F.min("tc_date").alias("_first"), F.max("tc_date").alias("_last"), F.count(F.lit(1)).alias("_trips")
    )
    return span.filter(F.col("_trips") > 1).select(
        F.col("hh_id").alias("household"), ratio(day_gap("_last", "_first"), F.col("_trips") - 1).alias("days")
    )
