"""Registry of the corpus queries and their SQL."""

from __future__ import annotations

from .embedding_dedup import op10_embedding_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_extraction import op1_html_extraction
from .license_scan import op4_license_scan
from .line_dedup import op6_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .near_dedup import op5_near_dedup
from .packing import op7_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import op8_quality_rules
from .secret_scan import op3_secret_scan
from .toxicity import op13_toxicity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_mixing": op2_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_license_scan": op4_license_scan,
    "op5_near_dedup": op5_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}
ORACLES = {"op2_mixing": OP2_SQL, "op11_hard_negatives": OP11_SQL, "op12_filter_audit": OP12_SQL}
