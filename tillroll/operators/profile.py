"""Panel profile: counts of trips, households, retailers, products and purchases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import in_year
from tillroll.sources.layout import in_trip_year, without_year


def trips_in_year(trips: DataFrame, year: int | None) -> DataFrame:
    """Trips dated in ``year`` (all trips when ``year`` is None). The date range reaches
    the Parquet scan as pushed filters; on the year-partitioned layout the partition
    column also prunes whole folders."""
    if year is None:
        return without_year(trips)
    return in_trip_year(trips, year).filter(in_year("tc_date", year))


def trip_count(trips: DataFrame, year: int | None = None) -> DataFrame:
    """Trips with a known household."""
    return trips_in_year(trips, year).agg(F.count("hh_id").alias("n_trips"))


def household_count(households: DataFrame, approx: bool = False) -> DataFrame:
    agg = F.approx_count_distinct("hh_id") if approx else F.countDistinct("hh_id")
    return households.agg(agg.alias("n_households"))


def retailer_count(trips: DataFrame, year: int | None = None) -> DataFrame:
    return trips_in_year(trips, year).agg(F.countDistinct("tc_retailer_code").alias("n_retailers"))


def products_per_group(products: DataFrame) -> DataFrame:
    """Products per category; a NULL category is its own row."""
    return products.groupBy("group_at_prod_id").agg(F.count("prod_id").alias("n_products"))


def products_per_module(products: DataFrame) -> DataFrame:
    return products.groupBy("module_at_prod_id").agg(F.count("prod_id").alias("n_products"))


def department_profile(products: DataFrame) -> DataFrame:
    """Distinct products and distinct modules per department, in one aggregation
    (departments that are NULL are left out)."""
    return (
        products.filter(F.col("department_at_prod_id").isNotNull())
        .groupBy(F.col("department_at_prod_id").alias("department"))
        .agg(
            F.countDistinct("prod_id").alias("products"),
            F.countDistinct("module_at_prod_id").alias("module"),
        )
    )


def purchase_count(purchases: DataFrame) -> DataFrame:
    return purchases.agg(F.count("tc_id").alias("n_purchases"))


def deal_purchase_count(purchases: DataFrame) -> DataFrame:
    """Purchase lines bought on a deal (flag = 1)."""
    return purchases.filter(F.col("deal_flag_at_tc_prod_id") == 1).agg(
        F.count("tc_id").alias("n_deal_purchases")
    )
