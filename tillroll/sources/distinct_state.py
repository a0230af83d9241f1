"""The monthly distinct sketches of a growing panel, kept on storage and merged load by load
(``sources.versions``): a new load costs its own trips, and a count over any range of months
reads a few kilobytes a month (``operators.distinct.approx_distinct``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.operators.distinct import LG_K, merge_sketches, month_sketches
from tillroll.sources.versions import add_load, loads_in, read_state

__all__ = ["add_trips", "loads_in", "read_state"]


def add_trips(trips: DataFrame, root: str, load: str, lg_k: int = LG_K) -> bool:
    """Merge the sketches of the load named ``load`` into those at ``root``; False, and nothing
    changes, if they hold that load already. All loads of a root need one ``lg_k``."""
    return add_load(month_sketches(trips, lg_k), merge_sketches, root, load)
