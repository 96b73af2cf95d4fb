"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import embeddings, fingerprints, jaccard, langid, mixing, pieces, pii, quality, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": embeddings.op1_near_vectors,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_nearest": embeddings.op3_nearest,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_mix": mixing.op6_mix,
    "op7_pii": pii.op7_pii,
    "op8_quality": quality.op8_quality,
    "op9_langid": langid.op9_langid,
    "op10_pieces": pieces.op10_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op6_mix": mixing.OP6_SQL,
}
