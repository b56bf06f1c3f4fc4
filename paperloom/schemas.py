"""Declared tables: parsed units and chunks."""

from __future__ import annotations

UNIT = "file_hash string, filename string, unit_no long, page long, sheet string, text string"
CHUNK = (
    "pk long, text string, filename string, chunk_index long, upload_time long, chunk_type string, section string, content_type string, "
    "file_hash string, parent_id string, parent_index long, child_index long, raw_text string, page long, page_start long, page_end long"
)
#: Longest values of the text columns of a chunk, and the columns that may be null.
MAX_LENGTHS = {"chunk_type": 32, "section": 256, "content_type": 16, "file_hash": 64, "parent_id": 64, "raw_text": 65535}
NULLABLE = ("page", "page_start", "page_end")
