"""Monthly behaviour (items and trips per household-month) and price vs quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import month_of
from tillroll.functions.stats import corr_matrix, exact_avg, fixed_avg, ratio
from tillroll.operators.profile import trips_in_year
from tillroll.sources.layout import in_trip_year

QTY = "quantity_at_tc_prod_id"
PAID = "total_price_paid_at_tc_prod_id"


def _known_households(df: DataFrame, households: DataFrame) -> DataFrame:
    return df.join(households.select("hh_id"), "hh_id", "left_semi")


def _month_lines(trips: DataFrame, purchases: DataFrame, year: int | None) -> DataFrame:
    """Per household and month: quantity sum, line count and row count of the purchase lines.
    Lines meet the year's trips first, so that only the year's lines are reduced."""
    t = trips_in_year(trips, year).select("tc_id", "hh_id", month_of("tc_date").alias("month"))
    return (
        in_trip_year(purchases, year)
        .select("tc_id", QTY)
        .join(t, "tc_id")
        .groupBy("hh_id", "month")
        .agg(F.sum(QTY).alias("_q"), F.count(QTY).alias("_lines"), F.count(F.lit(1)).alias("_rows"))
    )


def avg_items_by_month(trips: DataFrame, households: DataFrame, purchases: DataFrame, year: int | None) -> DataFrame:
    """Per household and month, the mean quantity of a purchase line; then the mean over
    households, per month: (month, num_items)."""
    per_hm = _month_lines(trips, purchases, year).withColumn("number", ratio("_q", "_lines"))
    return _known_households(per_hm, households).groupBy("month").agg(fixed_avg("number").alias("num_items"))


def avg_trips_by_month(trips: DataFrame, households: DataFrame, year: int | None) -> DataFrame:
    """Per household and month, the trip count; then the mean over the households that
    shopped that month: (month, num_trips)."""
    t = trips_in_year(trips, year).select("tc_id", "hh_id", month_of("tc_date").alias("month"))
    per_hm = t.groupBy("hh_id", "month").agg(F.count("tc_id").alias("number"))
    return (
        _known_households(per_hm, households)
        .groupBy("month")
        .agg(exact_avg("number").alias("num_trips"))
    )


def monthly_items_and_trips(
    trips: DataFrame, households: DataFrame, purchases: DataFrame, year: int | None
) -> DataFrame:
    """Mean items per line and mean trips per household, by month: (month, num_items,
    num_trips), for the months that have both.

    Trips and lines are both reduced per household and month before they meet, and the
    households are looked up once."""
    t = trips_in_year(trips, year).select("tc_id", "hh_id", month_of("tc_date").alias("month"))
    counted = t.groupBy("hh_id", "month").agg(F.count("tc_id").alias("_trips"))
    nothing = F.lit(None).cast("long")
    rows = counted.select("hh_id", "month", "_trips", nothing.alias("_q"), nothing.alias("_lines"), nothing.alias("_rows")).unionByName(
        _month_lines(trips, purchases, year).withColumn("_trips", nothing)
    )
    per_hm = rows.groupBy("hh_id", "month").agg(
        F.sum("_trips").alias("_trips"), ratio(F.sum("_q"), F.sum("_lines")).alias("_items"), F.sum("_rows").alias("_rows")
    )
    return (
        _known_households(per_hm, households)
        .groupBy("month")
        .agg(
            fixed_avg(F.when(F.col("_rows") > 0, F.col("_items"))).alias("num_items"),
            exact_avg("_trips").alias("num_trips"),
            F.sum("_rows").alias("_rows"),
        )
        .filter(F.col("_rows") > 0)
        .select("month", "num_items", "num_trips")
    )


def items_trips_corr(items_vs_trips: DataFrame) -> DataFrame:
    """Correlation matrix of month, num_items and num_trips: (var_x, var_y, corr)."""
    return corr_matrix(items_vs_trips, ["month", "num_items", "num_trips"])


def price_per_item(purchases: DataFrame) -> DataFrame:
    """Price paid per unit on each purchase line (NULL when the quantity is 0):
    (avg_price_paid_per_item, quantity_at_tc_prod_id)."""
    return purchases.select(
        ratio(PAID, QTY).alias("avg_price_paid_per_item"), F.col(QTY).alias(QTY)
    )


def price_quantity_corr(price_lines: DataFrame) -> DataFrame:
    return corr_matrix(price_lines, ["avg_price_paid_per_item", QTY])
