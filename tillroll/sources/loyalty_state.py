"""The loyalty state of a growing panel, kept on storage and merged load by load.

A load's trips are reduced to their state (``operators.loyalty.retailer_state``) and merged
with the stored one (``sources.versions``), so that a new month costs its own trips and one
pass over the state (a row per household and retailer), not a pass over all trips.
``operators.loyalty.share_of_state`` makes the shares of (hh_id, tc_retailer_code, spent,
month_mask).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.operators.loyalty import merge_state, retailer_state
from tillroll.sources.versions import add_load, loads_in, read_state

__all__ = ["add_trips", "loads_in", "read_state"]


def add_trips(trips: DataFrame, root: str, load: str) -> bool:
    """Merge the trips of the load named ``load`` (a file, a month) into the state at ``root``;
    False, and nothing changes, if the state holds that load already."""
    return add_load(retailer_state(trips), merge_state, root, load)
