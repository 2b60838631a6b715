"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from .bpe import op10_bpe
from .chat_format import OP4_SQL, op4_chat_format
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .fingerprint import op6_fingerprint
from .html_extract import op1_html_extract
from .mixing import op2_mixing
from .near_dedup import op7_near_dedup
from .pii import op8_pii
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .simhash import op12_simhash
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .toxicity import op3_toxicity
from .whitening import op13_whitening

QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_fingerprint": op6_fingerprint,
    "op7_near_dedup": op7_near_dedup,
    "op8_pii": op8_pii,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL = {"op4_chat_format": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL}
