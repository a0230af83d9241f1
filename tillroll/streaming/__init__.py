from tillroll.streaming.append import append_panel_files, panel_stream, raw_csv_schema

__all__ = ["append_panel_files", "panel_stream", "raw_csv_schema"]
