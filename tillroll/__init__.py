"""tillroll: household shopping-panel analytics as lazy Spark DataFrame operators.

Layout
------
- ``sources``    panel schema, readers (CSV / Parquet / driver tables) and writers
- ``functions``  column-expression helpers (date ranges, safe ratios, Pearson, labels)
- ``operators``  the analyses: profile, gaps, loyalty, monthly, private label, chart data
- ``plans``      the query catalog (fixture parameters), its DuckDB oracle, plan checks
- ``streaming``  incremental (append) panel loading with Structured Streaming

Every operator takes DataFrames (or a ``Panel``) and returns a DataFrame; nothing is
collected to the driver.
"""

from tillroll.sources.panel import Panel, panel_from_tpch, read_panel

__all__ = ["Panel", "panel_from_tpch", "read_panel"]
