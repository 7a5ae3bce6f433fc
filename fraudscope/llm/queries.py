"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from fraudscope.llm.chat import OP3_SQL, op3_chat_formatting
from fraudscope.llm.exact_dedup import op2_exact_dedup
from fraudscope.llm.jaccard_join import op7_ngram_jaccard_join
from fraudscope.llm.licenses import op1_license_scan, scan_sql
from fraudscope.llm.merkle import OP12_SQL, op12_merkle_manifest
from fraudscope.llm.mixing import op6_mixing_to_target_weights
from fraudscope.llm.packing import op9_best_fit_packing
from fraudscope.llm.phrases import OP11_SQL, op11_phrase_collocations
from fraudscope.llm.quality_classifier import op10_quality_classifier
from fraudscope.llm.quality_rules import OP4_SQL, op4_quality_rules
from fraudscope.llm.suffix_dedup import op8_suffix_array_dedup
from fraudscope.llm.token_counts import op5_token_counts
from fraudscope.llm.vector_search import OP13_SQL, op13_exact_top_k

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_exact_dedup,
        op3_chat_formatting,
        op4_quality_rules,
        op5_token_counts,
        op6_mixing_to_target_weights,
        op7_ngram_jaccard_join,
        op8_suffix_array_dedup,
        op9_best_fit_packing,
        op10_quality_classifier,
        op11_phrase_collocations,
        op12_merkle_manifest,
        op13_exact_top_k,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

ORACLES = {
    "op1_license_scan": scan_sql(),
    "op2_exact_dedup": OP2_SQL,
    "op3_chat_formatting": OP3_SQL,
    "op4_quality_rules": OP4_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_exact_top_k": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
