"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_perspectives
from .decontaminate import OP9_SQL, op9_decontaminate
from .disclosure import OP12_SQL, op12_pii_disclosure
from .divergence import OP11_SQL, op11_source_divergence
from .jaccard import OP6_SQL, op6_jaccard_join
from .langid import op3_language_id
from .mixing import op1_mix_sources
from .substrings import OP2_SQL, op2_substring_dedup
from .tokencount import op4_token_counts
from .tokenfile import op7_token_ids
from .topk import OP10_SQL, op10_exact_topk
from .toxicity import op8_toxicity
from .veccode import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_ids": op7_token_ids,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_topk": op10_exact_topk,
    "op11_source_divergence": op11_source_divergence,
    "op12_pii_disclosure": op12_pii_disclosure,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op5_chat_perspectives": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_pii_disclosure": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
