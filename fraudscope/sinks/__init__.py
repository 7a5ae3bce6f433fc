"""Sinks: dashboard exports as delimited text, row-level tables as Parquet."""

from fraudscope.sinks.export import (
    DASHBOARD_FILES,
    export,
    export_all,
    export_parquet,
    export_row_tables,
    read_export,
)
from fraudscope.sinks.publish import monitoring_tables, publish_all

__all__ = [
    "DASHBOARD_FILES",
    "export",
    "export_all",
    "export_parquet",
    "export_row_tables",
    "monitoring_tables",
    "publish_all",
    "read_export",
]
