"""Private-label analyses: share of private-label products per category, private-label
spend share per month, and by household income band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import month_of, year_month
from tillroll.functions.labels import income_band, is_private_label
from tillroll.functions.stats import exact_avg, money_sum, ratio
from tillroll.operators.profile import trips_in_year
from tillroll.sources.layout import in_trip_year
from tillroll.sources.schema import INCOME_BANDS, PRIVATE_LABEL_BRAND

BRAND = "brand_at_prod_id"
GROUP = "group_at_prod_id"
PAID = "total_price_paid_at_tc_prod_id"


def private_label_share_by_group(
    products: DataFrame, brand: str = PRIVATE_LABEL_BRAND, match: str = "equals", case_insensitive: bool = False
) -> DataFrame:
    """Per category: private-label brand count, brand count, and their ratio in percent.
    One conditional aggregation; categories without private label (and a NULL category)
    are left out. Output (group_at_prod_id, count_pl, count_all, proportion)."""
    pl = is_private_label(BRAND, brand, match, case_insensitive)
    return (
        products.filter(F.col(GROUP).isNotNull())
        .groupBy(GROUP)
        .agg(
            F.count(F.when(pl, F.col(BRAND))).alias("count_pl"),
            F.count(BRAND).alias("count_all"),
        )
        .filter(F.col("count_pl") > 0)
        .withColumn("proportion", ratio("count_pl", "count_all") * 100)
    )


def top_private_label_groups(share_by_group: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` categories with the highest private-label proportion (ties by category)."""
    return share_by_group.orderBy(F.col("proportion").desc_nulls_last(), F.col(GROUP).asc()).limit(k)


def product_flags(
    products: DataFrame, brand: str = PRIVATE_LABEL_BRAND, match: str = "equals", case_insensitive: bool = False
) -> DataFrame:
    """One row per product id: (prod_id, _pl). Duplicate product rows collapse, so joins
    on it never multiply purchase lines."""
    return products.groupBy("prod_id").agg(
        F.max(F.coalesce(is_private_label(BRAND, brand, match, case_insensitive), F.lit(False))).alias("_pl")
    )


def monthly_private_label_spend(
    trips: DataFrame,
    purchases: DataFrame,
    products: DataFrame,
    year: int | None,
    brand: str = PRIVATE_LABEL_BRAND,
    match: str = "equals",
    case_insensitive: bool = False,
) -> DataFrame:
    """Per month: total spend on known products, private-label spend and private-label
    line count, in one pass. Output (month, all_prods, pl_prods, pl_lines).

    Lines meet the year's trips first, so that only the year's lines go on, and then the
    products; the one aggregation after that is by month and combined map-side. (Reducing
    lines per product before they meet the products saves next to nothing: most products
    are bought seldom in a month.) Which joins broadcast is left to the planner."""
    flags = product_flags(products, brand, match, case_insensitive)
    lines = in_trip_year(purchases, year).select("tc_id", "prod_id", PAID)
    t = trips_in_year(trips, year).select("tc_id", month_of("tc_date").alias("month"))
    pl = F.col("_pl")
    return (
        lines.join(t, "tc_id")
        .join(flags, "prod_id")
        .groupBy("month")
        .agg(money_sum(PAID).alias("all_prods"), money_sum(F.when(pl, F.col(PAID))).alias("pl_prods"), F.count_if(pl).alias("pl_lines"))
    )


def spend_by_month(monthly: DataFrame) -> DataFrame:
    """(month1, all_prods): spend per month on purchases of known products."""
    return monthly.select(F.col("month").alias("month1"), "all_prods")


def private_label_spend_by_month(monthly: DataFrame) -> DataFrame:
    """(month2, pl_prods) for months with private-label purchases."""
    return monthly.filter(F.col("pl_lines") > 0).select(F.col("month").alias("month2"), "pl_prods")


def private_label_expenditure_share(monthly: DataFrame) -> DataFrame:
    """(month, pl_prods, all_prods, share) for months with private-label purchases."""
    return monthly.filter(F.col("pl_lines") > 0).select(
        "month", "pl_prods", "all_prods", ratio("pl_prods", "all_prods").alias("share")
    )


def private_label_share_by_income_month(
    households: DataFrame,
    trips: DataFrame,
    purchases: DataFrame,
    products: DataFrame,
    brand: str = PRIVATE_LABEL_BRAND,
    match: str = "regex",
    bands=INCOME_BANDS,
    case_insensitive: bool = False,
) -> DataFrame:
    """Per income band and year-month: total spend, private-label spend and their ratio,
    for the months in which the band bought private label.
    Output (band, year_month, total, private, percentage).

    All bands in one pass: lines are marked by the private-label product ids (few: one brand's),
    the narrow trips get their household's band, the two meet on the trip id, and the one
    aggregation is by band and year-month, combined map-side."""
    pl_ids = (
        products.filter(is_private_label(BRAND, brand, match, case_insensitive))
        .select("prod_id")
        .distinct()
        .withColumn("_pl", F.lit(True))
    )
    banded = (
        households.select("hh_id", income_band("hh_income", bands).alias("band"))
        .filter(F.col("band").isNotNull())
        .distinct()
    )
    t = (
        trips.filter(F.col("tc_date").isNotNull())
        .select("tc_id", "hh_id", year_month("tc_date").alias("year_month"))
        .join(banded, "hh_id")
        .select("tc_id", "band", "year_month")
    )
    lines = purchases.select("tc_id", "prod_id", PAID).join(pl_ids, "prod_id", "left").select("tc_id", PAID, "_pl")
    return (
        lines.join(t, "tc_id")
        .groupBy("band", "year_month")
        .agg(money_sum(PAID).alias("total"), money_sum(F.when(F.col("_pl"), F.col(PAID))).alias("private"), F.count("_pl").alias("_pln"))
        .filter(F.col("_pln") > 0)
        .select("band", "year_month", "total", "private", ratio("private", "total").alias("percentage"))
    )


def private_label_by_income(monthly_by_band: DataFrame) -> DataFrame:
    """Per band: months, mean monthly total, mean monthly private-label spend, and the
    ratio of the two means. Output (band, months, avg_total, avg_private, percentage)."""
    return (
        monthly_by_band.groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("months"),
            exact_avg("total").alias("avg_total"),
            exact_avg("private").alias("avg_private"),
        )
        .withColumn("percentage", F.try_divide(F.col("avg_private"), F.col("avg_total")))
    )
