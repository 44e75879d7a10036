"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, licenses, line_dedup, mixing, near_dedup, neighbours, pieces, secrets, toxicity, url_rules

QUERIES = {
    "op10_pieces": pieces.query,
    "op1_licenses": licenses.query,
    "op2_toxicity": toxicity.query,
    "op3_line_dedup": line_dedup.query,
    "op4_secrets": secrets.query,
    "op5_url_rules": url_rules.query,
    "op6_mixing": mixing.query,
    "op7_neighbours": neighbours.query,
    "op8_near_dedup": near_dedup.query,
    "op9_exact_dedup": exact_dedup.query,
}

SQL = {
    "op6_mixing": mixing.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
