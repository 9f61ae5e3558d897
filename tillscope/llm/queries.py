"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillscope.llm import (
    decontamination, embedding_dedup, jaccard, line_dedup, packing, quality, resampling, secret_scan, sharding, substring_dedup, suffix_tree,
    toxicity, whitening,
)
from tillscope.llm.common import table

#: The byte-level BPE file of the packing query.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _docs(fn: Callable[..., DataFrame], *others: str) -> Callable[[SparkSession, str], DataFrame]:
    """Query: ``fn`` over the whole tables ``documents`` and ``others``."""
    return lambda spark, sf_dir: fn(spark, *(table(spark, sf_dir, t) for t in ("documents", *others)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_cnn": _docs(toxicity.toxicity_scores, "labels"),
    "op2_line_dedup": _docs(line_dedup.query),
    "op3_quality_qda": _docs(quality.quality_scores, "labels"),
    "op4_embedding_multi_index": lambda s, d: embedding_dedup.embedding_dedup(s, table(s, d, "embeddings")),
    "op5_secret_scan": _docs(lambda spark, docs: secret_scan.secret_spans(docs)),
    "op6_hierarchical_packing": _docs(lambda spark, docs: packing.pack_documents(docs, TOKENIZER)),
    "op7_ngram_jaccard_join": _docs(jaccard.jaccard_components),
    "op8_lpt_sharding": _docs(sharding.shard_documents),
    "op9_template_decontamination": _docs(decontamination.decontamination, "benchmark"),
    "op10_recompression_dedup": _docs(substring_dedup.substring_dedup),
    "op11_mixed_precision_whitening": lambda s, d: whitening.whiten(s, table(s, d, "embeddings")),
    "op12_suffix_tree_scores": _docs(suffix_tree.lm_scores),
    "op13_head_tail_resampling": _docs(resampling.resample, "benchmark"),
}

#: DuckDB SQL where it can express the operator; the others are held against
#: brute force, an exact round trip or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE}
