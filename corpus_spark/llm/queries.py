"""Registered queries of this subpackage and their DuckDB oracle SQL."""

from .bpe_codec import op9_byte_bpe
from .chat_format import OP10_SQL, op10_chat_format
from .fingerprint import op8_fingerprints
from .gam import op5_quality_gam
from .lattice_lm import op3_lattice_lm
from .line_quality import OP2_SQL, op2_line_quality
from .near_dup import OP7_SQL, op7_near_duplicates
from .packing import op6_packing
from .periodic_runs import op12_periodic_runs
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .secret_scan import op4_secret_scan
from .token_blocks import op1_token_blocks
from .toxicity import op11_toxicity

LLM_QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_line_quality": op2_line_quality,
    "op3_lattice_lm": op3_lattice_lm,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_gam": op5_quality_gam,
    "op6_packing": op6_packing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_fingerprints": op8_fingerprints,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_chat_format": op10_chat_format,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
}

LLM_ORACLES: dict[str, str] = {
    "op2_line_quality": OP2_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op10_chat_format": OP10_SQL,
    "op13_prefix_trie": OP13_SQL,
}
