"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .audit import OP11_SQL, op11_query
from .bpe import op4_query
from .fingerprint import op2_query
from .licenses import op7_query
from .packing import op1_query
from .periodic import op12_query
from .quality import OP8_SQL, op8_query
from .secrets import op9_query
from .simhash import op6_query
from .substring import OP5_SQL, op5_query
from .tokens import op13_query
from .toxicity import op10_query
from .urls import OP3_SQL, op3_query

QUERIES = {
    "op1_best_fit_packing": op1_query,
    "op2_fingerprints": op2_query,
    "op3_url_filter": op3_query,
    "op4_bpe": op4_query,
    "op5_substring_dedup": op5_query,
    "op6_simhash": op6_query,
    "op7_licenses": op7_query,
    "op8_quality": op8_query,
    "op9_secrets": op9_query,
    "op10_toxicity": op10_query,
    "op11_filter_audit": op11_query,
    "op12_periodic_runs": op12_query,
    "op13_byte_bpe": op13_query,
}

ORACLE_SQL = {
    "op3_url_filter": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op8_quality": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
}
