"""Seed blocks: one block per token that passes a gate. Blocks are rows (key, ref_id), key an array of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.tokens import distinct_tokens, frequency_cap, gate, mean_gate


def _as_blocks(rows: DataFrame) -> DataFrame:
    return rows.select(F.array("token").alias("key"), "ref_id")


def _gated(records: DataFrame, freq: DataFrame, cap: int | None, min_length: int, exclude_numeric: bool, full: bool) -> DataFrame:
    """(token, freq, gate): gates are judged once per distinct token."""
    if full:
        return freq.withColumn("gate", gate(F.col("token"), F.col("freq"), None, min_length, exclude_numeric, True))
    if cap is not None:
        return freq.withColumn("gate", gate(F.col("token"), F.col("freq"), cap, min_length, exclude_numeric, False))
    bound = frequency_cap(freq).withColumnRenamed("freq", "cap")
    judged = freq.crossJoin(F.broadcast(bound))  # one row
    return judged.withColumn("gate", gate(F.col("token"), F.col("freq"), F.col("cap"), min_length, exclude_numeric, False)).drop("cap")


def seed_blocks(
    records: DataFrame, freq: DataFrame, init_df_max: int | None = None, min_length: int = 4, exclude_numeric: bool = True, full: bool = False
) -> DataFrame:
    """Blocks of tokens that are long enough, not numeric and of a frequency from 2 to init_df_max (by default the 95th
    percentile); with full, of all tokens of frequency 2 or more (B1)."""
    kept = _gated(records, freq, init_df_max, min_length, exclude_numeric, full).where(F.col("gate") == "kept").select("token")
    return _as_blocks(distinct_tokens(records).join(kept, "token"))


def gate_counters(
    records: DataFrame, freq: DataFrame, init_df_max: int | None = None, min_length: int = 4, exclude_numeric: bool = True, full: bool = False
) -> DataFrame:
    """(gate, n): distinct tokens of records by the gate they meet first. A token of record frequency d counts d times."""
    judged = _gated(records, freq, init_df_max, min_length, exclude_numeric, full)
    per_token = distinct_tokens(records).groupBy("token").agg(F.count(F.lit(1)).alias("d"))
    return judged.join(per_token, "token").groupBy("gate").agg(F.sum("d").alias("n"))


def beta_blocks(records: DataFrame, freq: DataFrame, beta: int) -> DataFrame:
    """Blocks of tokens of frequency beta or more (B2, P5)."""
    return _as_blocks(distinct_tokens(records).join(freq.where(F.col("freq") >= beta).select("token"), "token"))


def mean_blocks(records: DataFrame, freq: DataFrame, factor: float = 1.1) -> DataFrame:
    """Blocks of tokens of at least factor times the mean frequency."""
    return _as_blocks(distinct_tokens(records).join(mean_gate(freq, factor, False).select("token"), "token"))


def inverted_index(blocks: DataFrame) -> DataFrame:
    """(key, ref_ids): members collected per block (G6). Blocks must be capped first: a row holds a whole block."""
    return blocks.groupBy("key").agg(F.array_sort(F.collect_set("ref_id")).alias("ref_ids"))
