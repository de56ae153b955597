"""One query for each operator, with production parameters, over its whole table. None of these is expressible in SQL: each is tested
against brute force, an exact round trip or held-out accuracy."""

from .ann import op1_nearest
from .decontaminate import op5_decontaminate
from .line_dedup import op8_lines
from .packing import op3_packing
from .pii import op7_pii
from .quality import op10_quality
from .simhash import op4_simhash
from .suffix_dedup import op2_repeats
from .token_counts import op6_token_counts
from .toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_nearest, op2_repeats, op3_packing, op4_simhash, op5_decontaminate, op6_token_counts, op7_pii, op8_lines, op9_toxicity, op10_quality)}
ORACLE_SQL: dict[str, str] = {}
