"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_format
from .decontaminate import op7_decontaminate
from .licenses import op10_license_scan
from .packing import op8_packing
from .pii import op4_pseudonyms
from .quality import op9_quality_rules
from .scoring import op6_lm_scores
from .secrets import op2_secret_scan
from .simhash import op3_simhash
from .token_files import op1_token_files

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_chat_format": op5_chat_format,
    "op6_lm_scores": op6_lm_scores,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL = {
    "op5_chat_format": OP5_SQL,
}
