"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from trustlens.llm import merkle, source_mixing
from trustlens.llm.decontamination import op5_decontamination
from trustlens.llm.jaccard_join import op2_shingle_jaccard_join
from trustlens.llm.language_id import op4_language_id
from trustlens.llm.license_scan import op9_license_alignment
from trustlens.llm.merkle import op12_merkle_manifest
from trustlens.llm.nearest import op11_hash_prefix_forest
from trustlens.llm.quality_classifier import op7_quality_classifier
from trustlens.llm.quality_rules import op1_quality_divergence
from trustlens.llm.repeated_bytes import op3_suffix_array_dedup
from trustlens.llm.source_mixing import op8_poisson_mixing
from trustlens.llm.substring_dedup import op6_substring_dedup
from trustlens.llm.training_order import op10_training_order
from trustlens.llm.whitening import op13_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        op1_quality_divergence, op2_shingle_jaccard_join, op3_suffix_array_dedup, op4_language_id, op5_decontamination, op6_substring_dedup,
        op7_quality_classifier, op8_poisson_mixing, op9_license_alignment, op10_training_order,
        op11_hash_prefix_forest, op12_merkle_manifest, op13_embedding_whitening,
    ]
    return {f.__name__: f for f in listed} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_poisson_mixing": source_mixing.SQL, "op12_merkle_manifest": merkle.SQL}
