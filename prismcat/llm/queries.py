"""Queries of this subpackage, one per operator, with their SQL where SQL can express them."""

from __future__ import annotations

from prismcat.llm import bpe, embedding_dedup, fingerprints, html_text, mixing, ngram_join, quality, token_files, toxicity, url_filter

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1,
    "op2_token_files": token_files.op2,
    "op3_bpe_segment_tree": bpe.op3,
    "op4_mix_sources": mixing.op4,
    "op5_ngram_jaccard": ngram_join.op5,
    "op5_ngram_links": ngram_join.op5_links,
    "op6_toxicity": toxicity.op6,
    "op7_fingerprints": fingerprints.op7,
    "op8_quality": quality.op8,
    "op9_url_filter": url_filter.op9,
    "op10_html_text": html_text.op10,
}
ORACLES = {"op1_embedding_dedup": embedding_dedup.OP1_SQL, "op4_mix_sources": mixing.OP4_SQL, "op5_ngram_jaccard": ngram_join.OP5_SQL}
