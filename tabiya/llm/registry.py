"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tabiya.llm.binary import op4_token_files
from tabiya.llm.filter_audit import ORACLE_OP11, op11_filter_interaction_audit
from tabiya.llm.fingerprints import op1_fingerprints
from tabiya.llm.languages import op3_language_id
from tabiya.llm.line_dedup import ORACLE_OP8, op8_line_dedup
from tabiya.llm.media import op7_media_columns
from tabiya.llm.merge_replay import op12_byte_bpe
from tabiya.llm.mixing import ORACLE_OP9, op9_mixing
from tabiya.llm.ngram_join import op5_ngram_jaccard_join
from tabiya.llm.packing import op2_best_fit_packing
from tabiya.llm.quality import op6_quality_classifier
from tabiya.llm.token_counts import op10_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_best_fit_packing,
        op3_language_id,
        op4_token_files,
        op5_ngram_jaccard_join,
        op6_quality_classifier,
        op7_media_columns,
        op8_line_dedup,
        op9_mixing,
        op10_token_counts,
        op11_filter_interaction_audit,
        op12_byte_bpe,
    )
}
ORACLES: dict[str, str] = {"op8_line_dedup": ORACLE_OP8, "op9_mixing": ORACLE_OP9, "op11_filter_interaction_audit": ORACLE_OP11}
