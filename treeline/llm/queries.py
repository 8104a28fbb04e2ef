"""Imports every operator module, so that each registers its query."""

from treeline.llm import (  # noqa: F401
    op1_toxicity,
    op2_suffix_dedup,
    op3_packing,
    op4_token_counts,
    op5_line_dedup,
    op6_simhash,
    op7_fingerprints,
    op8_pii,
    op9_url_rules,
    op10_decontamination,
    op11_collocations,
    op12_quality,
    op13_whitening,
)
from treeline.llm.registry import ORACLE, QUERIES  # noqa: F401
