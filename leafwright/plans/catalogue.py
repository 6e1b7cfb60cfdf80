"""Importing this module registers every query of the library."""

from ..operators import citations, details, extraction, further, gates, hierarchy, intervals, mapping, merging, outlines, passages, payloads, profile, records, repairs, runs, scalars, search, sequences, tables, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "citations", "details", "extraction", "further", "gates", "hierarchy", "intervals", "mapping", "merging", "outlines", "passages", "payloads", "profile", "records", "repairs", "runs", "scalars", "search", "sequences", "tables", "text"]
