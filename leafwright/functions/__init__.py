"""Column functions by name, for use outside the registered queries."""

from ..operators.details import asks_documents, asks_place, asks_table, chunks, first_number, first_present, one_line, ordered_capabilities, position_unit, readable_ratio, slide_title, squeezed, title_key
from ..operators.gates import body_signal, chart_signal, meaningful_ratio, page_role
from ..operators.mapping import strip_prefix, title_form, title_fragments
from ..operators.tables import to_number
from ..operators.text import collapse, estimate_tokens, match_form, stable_id, summary, token_overlap, tokens, truncate

__all__ = [
    "asks_documents", "asks_place", "asks_table", "body_signal", "chart_signal", "chunks", "collapse", "estimate_tokens", "first_number", "first_present",
    "match_form", "meaningful_ratio", "one_line", "ordered_capabilities", "page_role", "position_unit", "readable_ratio", "slide_title", "squeezed", "stable_id",
    "strip_prefix", "summary", "title_form", "title_fragments", "title_key", "to_number", "token_overlap", "tokens", "truncate",
]
