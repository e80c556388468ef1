"""The queries of this subpackage by name, and their SQL where SQL can state the result."""

from __future__ import annotations

from . import fingerprints, huffman, image_copies, line_quality, mixing, near_dup, packing, pitman_yor, token_counts, warc

_MODULES = (fingerprints, huffman, image_copies, line_quality, mixing, near_dup, packing, pitman_yor, token_counts, warc)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
