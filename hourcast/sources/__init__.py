"""Sources and sinks: table readers/writers and the test-data mappings."""

from hourcast.sources.tables import (
    preview,
    read_master,
    read_metrics,
    read_projects,
    read_quotes,
    read_table,
    read_upload_log,
    require_columns,
    require_quote_columns,
    require_training_columns,
    upload_log_tail,
    write_csv,
    write_table,
)

__all__ = [
    "preview",
    "read_master",
    "read_metrics",
    "read_projects",
    "read_quotes",
    "read_table",
    "read_upload_log",
    "require_columns",
    "require_quote_columns",
    "require_training_columns",
    "upload_log_tail",
    "write_csv",
    "write_table",
]
