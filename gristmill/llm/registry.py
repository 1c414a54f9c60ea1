"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

# name: (module, function, SQL constant or None)
LISTED = {
    "op1_url_filters": ("url_filter", "op1_url_filters", "OP1_SQL"),
    "op2_mixing": ("mixing", "op2_mixing", None),
    "op7_bpe": ("bpe", "op7_bpe", None),
    "op8_language_id": ("language_id", "op8_language_id", None),
    "op10_html_text": ("html_text", "op10_html_text", None),
    "op4_warc": ("warc", "op4_warc", "OP4_SQL"),
    "op3_ann": ("ann", "op3_ann", None),
    "op9_jaccard_join": ("jaccard_join", "op9_jaccard_join", None),
    "op5_suffix_dedup": ("suffix_dedup", "op5_suffix_dedup", None),
    "op6_exact_dedup": ("exact_dedup", "op6_exact_dedup", "OP6_SQL"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gristmill.llm.{m}"), f) for name, (m, f, _) in LISTED.items()}


def oracle_sql() -> dict:
    return {name: getattr(importlib.import_module(f"gristmill.llm.{m}"), s) for name, (m, _, s) in LISTED.items() if s}
