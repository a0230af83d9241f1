"""The query catalog: every analysis as a function of a panel, for a set of parameters.

``analyses(params)`` maps each analysis name to ``Panel -> DataFrame``. ``STUDY`` holds
the panel study's own parameters (for real panels); ``P`` the parameters used on the
driver's tables; ``queries()`` binds the catalog to the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import chartdata as chart
from tillroll.operators import distinct, gaps, loyalty, monthly, private_label, profile
from tillroll.operators.sampling import sample_panel
from tillroll.sources.layout import without_year
from tillroll.sources.panel import Panel, panel_from_tpch
from tillroll.sources.schema import (
    ACTIVE_MONTHS,
    INACTIVE_MONTHS,
    INCOME_BANDS,
    PAIR_LOYAL_SHARE,
    PRIVATE_LABEL_BRAND,
    SINGLE_LOYAL_SHARE,
    SPEND_MONTHS,
)


@dataclass(frozen=True)
class Params:
    year: int = 2004
    min_months: int = ACTIVE_MONTHS
    months: int = SPEND_MONTHS
    single_threshold: float = SINGLE_LOYAL_SHARE
    pair_threshold: float = PAIR_LOYAL_SHARE
    brand: str = PRIVATE_LABEL_BRAND
    gap_months: int = INACTIVE_MONTHS
    gap_bins: int = 500
    gap_view: float = 16
    global_gap_days: int = INACTIVE_MONTHS * 30
    share_bins: int = 10
    scatter_bins: tuple[int, int] = (50, 50)
    max_points: int = 500
    top_groups: int = 5


# The study's own parameters (the year its trip analyses look at is 2004).
STUDY = Params()

# Parameters for the driver's tables: their data spans 1995-2001, only two customers shop
# in all twelve months and no single-retailer share reaches 80 %, so the year, the
# active-month, single-loyalty and global-gap thresholds are moved to give non-empty answers.
P = Params(year=1998, min_months=8, single_threshold=50, brand="Brand#1", global_gap_days=1)




# Digits kept when a correlation is compared with another engine's: the summation order of
# doubles differs in the last bits.
CORR_DIGITS = 6

PanelQuery = Callable[[Panel], DataFrame]


def analyses(params: Params = STUDY) -> dict[str, PanelQuery]:
    """Every analysis, bound to ``params``."""
    q = params

    # shared intermediate frames (lazy; each query builds the plan it needs)
    def active(p: Panel) -> DataFrame:
        return loyalty.monthly_active_households(p.trips, q.min_months)

    def active_trips(p: Panel) -> DataFrame:
        return loyalty.monthly_active_trips(p.trips, active(p))

    def share(p: Panel) -> DataFrame:
        return loyalty.active_retailer_share(p.trips, q.min_months, q.months)

    def single(p: Panel) -> DataFrame:
        return loyalty.loyal_single(share(p), q.single_threshold)

    def pair(p: Panel) -> DataFrame:
        return loyalty.loyal_pair(share(p), q.pair_threshold)

    def loyal(p: Panel) -> DataFrame:
        return loyalty.loyal_households(share(p), q.single_threshold, q.pair_threshold)

    def pairs(p: Panel) -> DataFrame:
        return gaps.next_trip_pairs(p.trips, q.year)

    def household_gaps(p: Panel) -> DataFrame:
        return gaps.household_gaps(p.trips, q.year)

    def gap_histogram(p: Panel, **options) -> DataFrame:
        # a household's few gaps are added up first: as many rows as there are different gaps
        counted = household_gaps(p).groupBy("time_window").agg(F.sum("n").alias("n"))
        return chart.histogram(counted, "time_window", q.gap_bins, weight="n", few=True, **options)

    def price_points(p: Panel) -> DataFrame:
        # the key is the purchase line itself, its price in cents
        paid = F.col(monthly.PAID)
        line = p.purchases.withColumn("_price", F.try_divide(paid.cast("double"), F.col(monthly.QTY)))
        key = ["tc_id", "prod_id", monthly.QTY, (paid * 100).cast("long")]
        return chart.scatter_frame(line, "_price", monthly.QTY, max_points=q.max_points, key=key)

    def items(p: Panel) -> DataFrame:
        return monthly.avg_items_by_month(p.trips, p.households, p.purchases, q.year)

    def trips_by_month(p: Panel) -> DataFrame:
        return monthly.avg_trips_by_month(p.trips, p.households, q.year)

    def ivt(p: Panel) -> DataFrame:
        return monthly.monthly_items_and_trips(p.trips, p.households, p.purchases, q.year)

    def pl_monthly(p: Panel) -> DataFrame:
        return private_label.monthly_private_label_spend(p.trips, p.purchases, p.products, q.year, q.brand, "equals")

    def band_months(p: Panel, bands=INCOME_BANDS) -> DataFrame:
        return private_label.private_label_share_by_income_month(
            p.households, p.trips, p.purchases, p.products, q.brand, "regex", bands
        )

    def pl_group(p: Panel) -> DataFrame:
        return private_label.private_label_share_by_group(p.products, q.brand, "equals")

    out: dict[str, PanelQuery] = {
        # ---- ingest ----
        "panel_households": lambda p: p.households,
        "panel_products": lambda p: p.products,
        "panel_trips": lambda p: without_year(p.trips),
        "panel_purchases": lambda p: without_year(p.purchases),
        "sample_by_keys": lambda p: without_year(sample_panel(p, active(p)).purchases),
        # ---- profile ----
        "trips_in_year": lambda p: profile.trips_in_year(p.trips, q.year),
        "trip_count": lambda p: profile.trip_count(p.trips, q.year),
        "household_count": lambda p: profile.household_count(p.households),
        "retailer_count": lambda p: profile.retailer_count(p.trips, q.year),
        "distinct_by_quarter": lambda p: distinct.distinct_by_quarter(p.trips),
        "products_per_group": lambda p: profile.products_per_group(p.products),
        "products_per_module": lambda p: profile.products_per_module(p.products),
        "department_profile": lambda p: profile.department_profile(p.products),
        "purchase_count": lambda p: profile.purchase_count(p.purchases),
        "deal_purchase_count": lambda p: profile.deal_purchase_count(p.purchases),
        # ---- gaps ----
        "trip_sequence_by_date": lambda p: gaps.trip_sequence(p.trips, q.year, by="date"),
        "trip_sequence_by_household": lambda p: gaps.trip_sequence(p.trips, q.year, by="household"),
        "next_trip_pairs": pairs,
        "inactive_gap_count": lambda p: gaps.inactive_gap_count(household_gaps(p), q.gap_months),
        "global_gap_count": lambda p: gaps.global_gap_count(p.trips, q.year, q.global_gap_days),
        "avg_gap_per_household": lambda p: gaps.avg_gap_per_household(p.trips, q.year),
        # ---- loyalty ----
        "monthly_active_households": active,
        "monthly_active_trips": active_trips,
        "household_avg_spend": lambda p: loyalty.active_household_avg_spend(p.trips, q.min_months, q.months),
        "household_retailer_avg_spend": lambda p: loyalty.active_household_retailer_avg_spend(
            p.trips, q.min_months, q.months
        ),
        "retailer_share": share,
        "loyal_single": single,
        "loyal_pair": pair,
        "loyal_pair_ordered": lambda p: loyalty.loyal_pair(share(p), q.pair_threshold, both_orders=True),
        "loyal_households": loyal,
        "loyal_household_income": lambda p: loyalty.loyal_household_income(loyal(p), p.households),
        "loyal_income_comparison": lambda p: loyalty.loyal_income_comparison(loyal(p), p.households, "pair"),
        "top_retailer_by_spend": lambda p: loyalty.top_retailer_by_spend(p.trips),
        "loyalists_by_retailer": lambda p: loyalty.loyalists_by_retailer(single(p)),
        "top_loyalist_retailer": lambda p: loyalty.top_loyalist_retailer(loyalty.loyalists_by_retailer(single(p))),
        "loyal_household_state": lambda p: loyalty.loyal_household_state(loyal(p), p.households),
        "loyal_state_distribution": lambda p: loyalty.loyal_state_distribution(
            loyalty.loyal_household_state(loyal(p), p.households)
        ),
        # ---- monthly behaviour, price ----
        "avg_items_by_month": items,
        "avg_trips_by_month": trips_by_month,
        "items_vs_trips_by_month": ivt,
        "items_trips_corr": lambda p: monthly.items_trips_corr(ivt(p)),
        "price_per_item": lambda p: monthly.price_per_item(p.purchases),
        "price_quantity_corr": lambda p: monthly.price_quantity_corr(monthly.price_per_item(p.purchases)),
        # ---- private label ----
        "private_label_share_by_group": pl_group,
        "top_private_label_groups": lambda p: private_label.top_private_label_groups(pl_group(p), q.top_groups),
        "spend_by_month": lambda p: private_label.spend_by_month(pl_monthly(p)),
        "private_label_spend_by_month": lambda p: private_label.private_label_spend_by_month(pl_monthly(p)),
        "private_label_expenditure_share": lambda p: private_label.private_label_expenditure_share(pl_monthly(p)),
        "private_label_by_income": lambda p: private_label.private_label_by_income(band_months(p)),
    }
    for band in INCOME_BANDS:
        out[f"private_label_by_income_{band[0]}"] = (
            lambda p, b=band: private_label.private_label_by_income(band_months(p, (b,)))
        )
    out.update({
        "private_label_share_by_income_month": band_months,
        # ---- chart data ----
        "bar_department_products": lambda p: chart.bar_frame(
            profile.department_profile(p.products), "department", "products"
        ),
        "bar_department_modules": lambda p: chart.bar_frame(
            profile.department_profile(p.products), "department", "module"
        ),
        "bar_group_proportion": lambda p: chart.bar_frame(pl_group(p), "group_at_prod_id", "proportion"),
        "bar_month_share": lambda p: chart.bar_frame(
            private_label.private_label_expenditure_share(pl_monthly(p)), "month", "share"
        ),
        "line_items_by_month": lambda p: chart.line_frame(items(p), "month", "num_items"),
        "line_trips_by_month": lambda p: chart.line_frame(trips_by_month(p), "month", "num_trips"),
        "gap_histogram": gap_histogram,
        "gap_histogram_view": lambda p: gap_histogram(p, view=(None, q.gap_view)),
        "income_share_histogram": lambda p: chart.histogram(band_months(p), "percentage", q.share_bins, few=True),
        "scatter_items_trips": lambda p: chart.scatter_frame(ivt(p), "num_items", "num_trips"),
        "scatter_price_quantity": lambda p: chart.scatter_frame(
            monthly.price_per_item(p.purchases), "avg_price_paid_per_item", "quantity_at_tc_prod_id", q.scatter_bins
        ),
        "scatter_price_points": price_points,
    })
    return out


def register_views(panel: Panel, params: Params = STUDY, prefix: str = "") -> list[str]:
    """Register the panel tables and the analyses as temporary views, so the catalog can be
    queried with ``spark.sql``. Views are lazy: registering runs no job, and a query over one
    runs only the plan it needs."""
    names = panel.register_views(prefix)
    for name, fn in analyses(params).items():
        if not name.startswith("panel_"):
            fn(panel).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
    return names


def panel_queries(params: Params = P) -> dict[str, PanelQuery]:
    return analyses(params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The catalog with the driver-table parameters, each entry taking (spark, sf_dir)."""

    def bind(name: str, fn: PanelQuery) -> Callable[[SparkSession, str], DataFrame]:
        if name.endswith("_corr"):
            return lambda spark, sf_dir: fn(panel_from_tpch(spark, sf_dir)).withColumn("corr", F.round("corr", CORR_DIGITS))
        return lambda spark, sf_dir: fn(panel_from_tpch(spark, sf_dir))

    return {name: bind(name, fn) for name, fn in analyses(P).items()}
