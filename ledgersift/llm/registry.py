"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from .chat_format import CHAT_SQL, chat_digest
from .conversation_trie import TRIE_SQL, conversation_trie
from .embedding_graph import embedding_dedup
from .hard_negatives import NEGATIVE_SQL, mined_negatives
from .interpolated_lm import lm_scores
from .line_dedup import LINE_SQL, line_dedup
from .piece_tokens import piece_tokens
from .quality_rules import quality_rules
from .secret_scan import secret_spans
from .simhash_dedup import simhash_dedup
from .source_mixing import source_mixing
from .toxicity import toxicity
from .url_filters import URL_SQL, url_verdicts

QUERIES = {
    "op1_simhash_dedup": simhash_dedup,
    "op2_quality_rules": quality_rules,
    "op3_embedding_dedup": embedding_dedup,
    "op4_source_mixing": source_mixing,
    "op5_url_filters": url_verdicts,
    "op6_piece_tokens": piece_tokens,
    "op7_secret_scan": secret_spans,
    "op8_toxicity": toxicity,
    "op9_chat_format": chat_digest,
    "op10_line_dedup": line_dedup,
    "op11_lm_scores": lm_scores,
    "op12_conversation_trie": conversation_trie,
    "op13_hard_negatives": mined_negatives,
}
ORACLES = {
    "op5_url_filters": URL_SQL,
    "op9_chat_format": CHAT_SQL,
    "op10_line_dedup": LINE_SQL,
    "op12_conversation_trie": TRIE_SQL,
    "op13_hard_negatives": NEGATIVE_SQL,
}
