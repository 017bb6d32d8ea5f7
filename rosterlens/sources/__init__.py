"""Sources: derived panel from the order tables, raw CSV, Parquet panel table."""

from rosterlens.sources.derived import PANEL_COLUMNS, panel_from_frames, panel_from_tables
from rosterlens.sources.raw_csv import (
    RAW_SCHEMA,
    check_employee_ids,
    check_panel_schema,
    import_panel_csv,
    read_panel_csv,
    typed_panel,
    write_panel_csv,
)
from rosterlens.sources.store import listing_digest, materialize_panel, read_panel, remove_panel, write_panel

__all__ = [
    "PANEL_COLUMNS",
    "RAW_SCHEMA",
    "check_employee_ids",
    "check_panel_schema",
    "import_panel_csv",
    "listing_digest",
    "materialize_panel",
    "panel_from_frames",
    "panel_from_tables",
    "read_panel",
    "read_panel_csv",
    "remove_panel",
    "typed_panel",
    "write_panel",
    "write_panel_csv",
]
