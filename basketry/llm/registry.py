"""Queries of this subpackage by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from . import filter_audit, repeats, vector_codes
from .decontamination import op7_decontamination
from .filter_audit import op13_filter_audit
from .language_model import op8_lm_scoring
from .licenses import op3_license_scan
from .packing import op4_best_fit_packing
from .pii import op10_pii_surrogates
from .quality_classifier import op5_quality_classifier
from .quality_rules import op9_quality_rules
from .repeats import op12_suffix_dedup
from .sharding import op2_sharding
from .simhash import op6_simhash_dedup
from .token_ids import op1_token_ids
from .vector_codes import op11_vector_codes

QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_sharding": op2_sharding,
    "op3_license_scan": op3_license_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_vector_codes": op11_vector_codes,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op11_vector_codes": vector_codes.sql(), "op12_suffix_dedup": repeats.SQL, "op13_filter_audit": filter_audit.SQL}
