"""The training-data operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontamination
from .fingerprints import op9_fingerprints
from .language import op10_language
from .lm import op3_lm
from .line_dedup import OP2_SQL, op2_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .pii import op5_pii
from .quality import op4_quality
from .simhash_dedup import op1_simhash
from .substring_dedup import op6_substring_dedup

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_lm": op3_lm,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_fingerprints": op9_fingerprints,
    "op10_language": op10_language,
}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op7_mixing": OP7_SQL, "op8_decontamination": OP8_SQL}
