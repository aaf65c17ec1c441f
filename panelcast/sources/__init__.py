"""Sources and sinks (S1-S9) plus the adapters that turn driver tables into panels."""

from panelcast.sources.adapters import EVENTS_SPEC, READINGS_SPEC, events_panel, lineitem_readings
from panelcast.sources.readings import RAW_SCHEMA, load_profile, read_readings, stage_dataset
from panelcast.sources.sinks import (
    IMPORTANCE_SCHEMA,
    metrics_schema,
    metrics_frame,
    preview,
    write_importance_csv,
    write_metrics_csv,
)

__all__ = [
    "EVENTS_SPEC", "READINGS_SPEC", "events_panel", "lineitem_readings",
    "RAW_SCHEMA", "load_profile", "read_readings", "stage_dataset",
    "IMPORTANCE_SCHEMA", "metrics_schema", "metrics_frame", "preview",
    "write_importance_csv", "write_metrics_csv",
]
