"""Resolution of personal records from raw lines: extract, normalise, block, match, cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weft.functions.pii import extract_records, labelled_fields, normalize_records
from weft.operators.blocks import candidate_pairs
from weft.operators.resolve import build_clusters, matched_pairs, split_oversize, token_blocks
from weft.session import cut


def resolve(raw: DataFrame, text_col: str = "value", extractor: Callable[[str], dict[str, str | None]] = labelled_fields, max_block_size: int = 100) -> DataFrame:
    """(record_id, cluster_id) of raw lines."""
    return resolve_records(extract_records(raw, text_col, extractor), max_block_size)


def resolve_records(records: DataFrame, max_block_size: int = 100) -> DataFrame:
    normal = cut(normalize_records(records))
    pairs = candidate_pairs(split_oversize(token_blocks(normal), max_block_size))
    return build_clusters(matched_pairs(pairs, normal), normal)
