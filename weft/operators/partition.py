"""Partitions: every record in exactly one block, split step by step by its most common further token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.blocks import block_sizes
from weft.operators.tokens import distinct_tokens, mean_gate
from weft.session import cut, measured


def initial_partition(records: DataFrame, freq: DataFrame, factor: float = 1.1) -> DataFrame:
    """(key, ref_id): each record under its most frequent token of at least factor times the mean frequency, the first in
    the record on ties; records without one under UNIQUE_<id> (B12, W4)."""
    placed = records.select("ref_id", F.posexplode("tokens").alias("pos", "token"))
    rated = placed.join(mean_gate(freq, factor, False), "token")
    best = rated.groupBy("ref_id").agg(F.max_by("token", F.struct("freq", -F.col("pos"))).alias("token"))
    named = records.select("ref_id").join(best, "ref_id", "left")
    return named.select(F.array(F.coalesce("token", F.concat(F.lit("UNIQUE_"), F.col("ref_id").cast("string")))).alias("key"), "ref_id")


def refine_partition(blocks: DataFrame, records: DataFrame, beta: int) -> DataFrame:
    """Every block of at least beta records is split by the token most of its members share besides its key, if at least beta
    do; ties by token. Members that have it move to the extended key; a key that already exists takes them in (B13, W5)."""
    large = block_sizes(blocks).where(F.col("size") >= beta).select("key")
    inside = blocks.join(large, "key", "left_semi").join(distinct_tokens(records), "ref_id").where(~F.array_contains("key", F.col("token")))
    counts = inside.groupBy("key", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= beta)
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").desc(), "token"))).where("rank = 1")
    moved = inside.join(best.select("key", "token"), ["key", "token"]).select("ref_id", F.array_sort(F.array_append("key", F.col("token"))).alias("to"))
    return blocks.join(moved, "ref_id", "left").select(F.coalesce("to", "key").alias("key"), "ref_id")


def iterative_partition(records: DataFrame, freq: DataFrame, stop_k: int, factor: float = 1.1) -> DataFrame:
    """Refinement with beta 2, 3, ..., stop_k until nothing changes."""
    with measured(records.sparkSession):
        blocks = cut(initial_partition(records, freq, factor))
        for beta in range(2, stop_k + 1):
            new = cut(refine_partition(blocks, records, beta))
            changed = new.join(blocks, ["key", "ref_id"], "left_anti")
            if changed.isEmpty():
                break
            blocks = new
    return blocks
