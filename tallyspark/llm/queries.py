"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import license_scan, metric_tree, ngram_join, source_mix
from .fingerprints import op2_document_fingerprints
from .language_id import op9_language_id
from .license_scan import op1_license_scan
from .metric_tree import op8_metric_tree_topk
from .ngram_join import op3_ngram_jaccard_join
from .source_mix import op5_source_mix
from .surrogates import op6_pii_surrogates
from .token_counts import op4_token_counts
from .toxicity import op10_toxicity
from .word_bpe import op7_bpe_coding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_token_counts": op4_token_counts,
        "op5_source_mix": op5_source_mix,
        "op6_pii_surrogates": op6_pii_surrogates,
        "op7_bpe_coding": op7_bpe_coding,
        "op8_metric_tree_topk": op8_metric_tree_topk,
        "op9_language_id": op9_language_id,
        "op10_toxicity": op10_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op8_metric_tree_topk": metric_tree.ORACLE, "op3_ngram_jaccard_join": ngram_join.ORACLE, "op5_source_mix": source_mix.ORACLE}
