from tillroll.sources.panel import Panel, panel_from_tpch, read_csv_table, read_panel, read_typed_csv
from tillroll.sources.sinks import export_csv, write_table

__all__ = ["Panel", "panel_from_tpch", "read_csv_table", "read_panel", "read_typed_csv", "export_csv", "write_table"]
