"""Key sampling: keep the rows of a table whose key appears in a key table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.sources.panel import Panel


def sample_by_keys(df: DataFrame, keys: DataFrame, key: str, keys_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys``; never duplicates rows of ``df``.

    A left-semi join: the planner broadcasts ``keys`` when its measured size is under the
    broadcast threshold and otherwise shuffles both sides (AQE splits a hot key)."""
    k = keys.select(keys[keys_key or key].alias(key))
    return df.join(k, key, "left_semi")


def sample_panel(
    panel: Panel, household_keys: DataFrame, key: str = "hh_id", product_keys: DataFrame | None = None
) -> Panel:
    """Referential sample: the listed households, their trips and those trips' purchases.
    Products are sampled by ``product_keys`` when given and stay whole otherwise."""
    households = sample_by_keys(panel.households, household_keys, "hh_id", key)
    trips = sample_by_keys(panel.trips, household_keys, "hh_id", key)
    purchases = sample_by_keys(panel.purchases, trips.select("tc_id"), "tc_id")
    products = panel.products if product_keys is None else sample_by_keys(panel.products, product_keys, "prod_id")
    return Panel(households, products, trips, purchases)
