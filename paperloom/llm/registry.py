"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from .bpe import op1_bpe
from .centroids import OP12_SQL, op12_centroids
from .chat import OP3_SQL, op3_chat
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .fingerprints import op9_fingerprints
from .html_text import op4_html_text
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .line_dedup import OP2_SQL, op2_line_dedup
from .merkle import OP11_SQL, op11_merkle
from .packing import op6_packing
from .secrets import op13_secrets
from .token_counts import op5_token_counts
from .toxicity import op10_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat": op3_chat,
    "op4_html_text": op4_html_text,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_centroids": op12_centroids,
    "op13_secrets": op13_secrets,
}
SQL = {"op2_line_dedup": OP2_SQL, "op3_chat": OP3_SQL, "op7_jaccard_join": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_merkle": OP11_SQL, "op12_centroids": OP12_SQL}
