"""The text operators' queries by name; each runs over its whole table."""

from __future__ import annotations

from .bpe import op4_bpe_codec
from .decontaminate import op9_decontaminate
from .katz import op7_katz
from .language import op2_language
from .manifest import OP13_SQL, op13_merkle
from .media import op8_media
from .negatives import OP12_SQL, op12_hard_negatives
from .pii import op5_pii
from .simhash import op6_simhash
from .token_counts import op10_token_counts
from .token_files import op3_token_files
from .toxicity import op1_toxicity
from .urls import op11_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_language, op3_token_files, op4_bpe_codec, op5_pii, op6_simhash, op7_katz, op8_media, op9_decontaminate, op10_token_counts,
        op11_url_filter, op12_hard_negatives, op13_merkle,
    )
}
#: SQL cannot express the other operators over whole tables; tests hold them against brute force.
SQL: dict[str, str] = {"op12_hard_negatives": OP12_SQL, "op13_merkle": OP13_SQL}
