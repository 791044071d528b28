"""Signature workflow: variations of the vocabulary, signatures of records, blocks, balanced splits, pairs."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from weft.operators import signature as S
from weft.operators.blocks import candidate_pairs
from weft.operators.tokens import document_frequency, remove_frequent_tokens
from weft.session import cut


@dataclass(frozen=True)
class SignatureRun:
    record_sigs: DataFrame
    blocks: DataFrame
    leaves: DataFrame
    pairs: DataFrame
    timings: dict[str, float]


def run(
    records: DataFrame, max_frequency: int = 60, method: str = "data_quality", threshold: int = 85, use_lsh: bool = False,
    lsh_threshold: float = 0.5, max_depth: int = 3, min_size: int = 2, mapping: DataFrame | None = None,
) -> SignatureRun:
    """Phases 0 to 3 with seconds per phase (X8). In exact mode no signature can part a block, so phase 3 is skipped."""
    clock, timings = time.monotonic(), {}

    def lap(name: str) -> None:
        nonlocal clock
        timings[name], clock = time.monotonic() - clock, time.monotonic()

    kept = cut(remove_frequent_tokens(records, document_frequency(records), max_frequency))
    tokens = cut(S.vocabulary(kept))
    variants = cut(S.variations(tokens, method, threshold, mapping))
    lap("phase_0")
    record_sigs = cut(S.record_signatures(kept, S.token_signatures(S.set_signatures(variants), tokens)))
    lap("phase_1")
    blocks = cut(S.lsh_blocks(record_sigs, lsh_threshold) if use_lsh else S.exact_blocks(record_sigs))
    lap("phase_2")
    leaves = S.split_blocks(blocks, record_sigs, max_depth, min_size) if use_lsh else blocks.withColumnRenamed("key", "label")
    leaves = cut(leaves)
    lap("phase_3")
    return SignatureRun(record_sigs, blocks, leaves, candidate_pairs(leaves.withColumnRenamed("label", "key")), timings)
