"""Panel storage layout for large panels: trips and purchases partitioned by trip year.

Single-year analyses then read only that year's folders (partition pruning) instead of
scanning every purchase line. Each purchase line takes the year of its trip (one join at
write time); lines whose trip is unknown land in the NULL-year partition. Writes use the
``rebalance`` hint, so AQE splits oversized partitions and merges small ones: one year (or
one hot household) does not become one writer task, and small years do not make many
tiny files.

``write_panel_tables`` is the other layout, for studies over many years: trips and purchases
as catalog tables bucketed by trip id, whose joins need no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.sources.panel import Panel
from tillroll.sources.schema import YEAR_COL
from tillroll.sources.sinks import write_table


def trips_with_year(trips: DataFrame) -> DataFrame:
    return trips.withColumn(YEAR_COL, F.year("tc_date"))


def purchases_with_year(purchases: DataFrame, trips: DataFrame) -> DataFrame:
    """Purchases with the year of their trip. A trip id that occurs several times, as after
    a repeated append, does not multiply lines; should its dates differ, its first year is
    taken."""
    years = trips.groupBy("tc_id").agg(F.min(F.year("tc_date")).alias(YEAR_COL))
    return purchases.join(years, "tc_id", "left")


def write_panel(panel: Panel, root: str, mode: str = "overwrite") -> dict[str, str]:
    """Write the panel as Parquet under ``root``; returns the paths for ``read_panel``."""
    root = root.rstrip("/")
    paths = {name: f"{root}/{name}" for name in ("households", "products", "trips", "purchases")}
    write_table(panel.households, paths["households"], mode)
    write_table(panel.products, paths["products"], mode)
    trips = trips_with_year(panel.trips).hint("rebalance", YEAR_COL)
    write_table(trips, paths["trips"], mode, partition_by=[YEAR_COL])
    purchases = purchases_with_year(panel.purchases, panel.trips).hint("rebalance", YEAR_COL)
    write_table(purchases, paths["purchases"], mode, partition_by=[YEAR_COL])
    return paths


def write_panel_tables(panel: Panel, prefix: str = "", buckets: int = 200, mode: str = "overwrite") -> dict[str, str]:
    """Write the panel as catalog tables ``<prefix>households`` and so on; returns the names for
    ``read_panel(fmt="table")``.

    Trips and purchases are bucketed and sorted by trip id, both into ``buckets`` buckets, so
    that every join of lines and trips, the one large shuffle of the studies, reads matching
    buckets side by side without an exchange; the shuffle is paid once, when the tables are
    written. ``buckets`` should give files of some hundred MB; a bucket is a task of those joins.
    Trip ids are unique, so a household or product with very many lines is spread evenly."""
    names = {name: f"{prefix}{name}" for name in ("households", "products", "trips", "purchases")}
    write_table(panel.households, names["households"], mode, as_table=True)
    write_table(panel.products, names["products"], mode, as_table=True)
    for name in ("trips", "purchases"):
        # dealt as the buckets are, so that each task writes whole buckets, one file each
        dealt = without_year(panel.table(name)).repartition(buckets, "tc_id")
        dealt.write.mode(mode).bucketBy(buckets, "tc_id").sortBy("tc_id").saveAsTable(names[name])
    return names


def in_trip_year(df: DataFrame, year: int | None) -> DataFrame:
    """Restrict a trips or purchases frame to one trip year through its partition column,
    when the frame has one (a no-op otherwise). The column itself goes."""
    if year is not None and YEAR_COL in df.columns:
        df = df.filter(F.col(YEAR_COL) == year)
    return without_year(df)


def without_year(df: DataFrame) -> DataFrame:
    """A frame without the layout's partition column."""
    return df.drop(YEAR_COL)
