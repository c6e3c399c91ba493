"""Readers and writers."""

from tunestrata.sources.attributes import (
    attribute_type_census,
    read_attributes,
    schema_from_attributes,
)
from tunestrata.sources.catalog import AUDIO_FEATURE_SETS, Catalog
from tunestrata.sources.files import (
    line_count,
    preview,
    read_delimited,
    read_inferred,
    read_table,
    storage_inventory,
)
from tunestrata.sources.matchlog import losses, malformed_lines, parse_marked, parse_match_log
from tunestrata.sources.sinks import checkpoint, export_csv, load_model, save_model

__all__ = [
    "AUDIO_FEATURE_SETS",
    "Catalog",
    "attribute_type_census",
    "checkpoint",
    "export_csv",
    "line_count",
    "load_model",
    "losses",
    "malformed_lines",
    "parse_marked",
    "parse_match_log",
    "preview",
    "read_attributes",
    "read_delimited",
    "read_inferred",
    "read_table",
    "save_model",
    "schema_from_attributes",
    "storage_inventory",
]
