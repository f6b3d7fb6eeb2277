"""Sources and sinks."""

from stepweave.sources.tables import (
    cut_lineage,
    pick_conversion,
    read_categories,
    read_events,
    read_journeys,
    read_journeys_csv,
    read_rules,
    shared_folder,
    store_hits,
    write_csv,
    write_events,
    write_snapshot,
)

__all__ = [
    "cut_lineage",
    "pick_conversion",
    "read_categories",
    "read_events",
    "read_journeys",
    "read_journeys_csv",
    "read_rules",
    "shared_folder",
    "store_hits",
    "write_csv",
    "write_events",
    "write_snapshot",
]
