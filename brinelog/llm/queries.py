"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .binary_packs import op8_token_id_output
from .bpe import op12_bpe_coding
from .chat import OP4_SQL, op4_chat_formatting
from .fingerprint import op10_document_fingerprints
from .jaccard import op3_jaccard_join
from .kmeans import OP11_SQL, op11_centroid_clustering
from .langid import op9_language_id
from .media import op7_media_columns
from .mixing import OP1_SQL, op1_mix_sources
from .negatives import OP13_SQL, op13_hard_negatives
from .packing import op2_best_fit_packing
from .quality import op6_quality_classifier
from .suffix_tree import op5_lm_scoring


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [
        op1_mix_sources, op2_best_fit_packing, op3_jaccard_join, op4_chat_formatting, op5_lm_scoring, op6_quality_classifier,
        op7_media_columns, op8_token_id_output, op9_language_id, op10_document_fingerprints, op11_centroid_clustering, op12_bpe_coding, op13_hard_negatives, pipeline,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op4_chat_formatting": OP4_SQL, "op11_centroid_clustering": OP11_SQL, "op13_hard_negatives": OP13_SQL}
