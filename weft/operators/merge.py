"""Blocks from token combinations, and blocks merged by what they share.

Merging blocks that share a record (or keys that share a token) until nothing changes gives the connected components of
the graph between blocks and records (or tokens), so that is what is computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.blocks import dedup_blocks, key_order
from weft.operators.components import connected_components
from weft.operators.tokens import mean_gate, term_frequency
from weft.session import cut


def _block_roots(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, root) from shared(key, item): keys connected through items. Nodes are told apart by a prefix."""
    name = F.concat(F.lit("b:"), F.array_join("key", "\x1f"))
    links = shared.select(name.alias("a"), F.concat(F.lit("i:"), F.col("item").cast("string")).alias("b"))
    roots = connected_components(links)
    return blocks.select("key").distinct().withColumn("node", name).join(roots, "node").select("key", "root")


def merge_sharing_records(blocks: DataFrame) -> DataFrame:
    """Components of blocks that share records: (key, ref_id), key the sorted union of all member keys."""
    roots = cut(_block_roots(blocks, blocks.select("key", F.col("ref_id").alias("item"))))
    keys = roots.groupBy("root").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("key")))).alias("merged"))
    return blocks.join(roots, "key").join(keys, "root").select(F.col("merged").alias("key"), "ref_id").distinct()


def merge_sharing_key_tokens(blocks: DataFrame) -> DataFrame:
    """Components of blocks whose keys share a token: (key, ref_id), key the smallest member key."""
    tokens = blocks.select("key").distinct().select("key", F.explode("key").alias("item"))
    roots = cut(_block_roots(blocks, tokens))
    keys = roots.groupBy("root").agg(F.min_by("key", key_order()).alias("merged"))
    return blocks.join(roots, "key").join(keys, "root").select(F.col("merged").alias("key"), "ref_id").distinct()


def combination_blocks(records: DataFrame, valid: DataFrame, k: int) -> DataFrame:
    """(key, ref_id): one block per combination of k valid tokens of a record.

    Combinations are grown one token at a time within a record's row, in sorted order, so each arises once.
    """
    kept = records.select("ref_id", F.explode(F.array_distinct("tokens")).alias("token")).join(valid.select("token"), "token")
    rows = kept.groupBy("ref_id").agg(F.array_sort(F.collect_list("token")).alias("ts")).where(F.size("ts") >= k)
    grown = rows.select("ref_id", "ts", F.array().cast("array<string>").alias("key"), F.lit(0).alias("at"))
    for step in range(k):
        left = k - step - 1
        places = F.when(F.col("at") <= F.size("ts") - 1 - left, F.sequence(F.col("at"), F.size("ts") - 1 - left))
        grown = grown.select("ref_id", "ts", "key", F.explode(places).alias("i")).select(
            "ref_id", "ts", F.array_append("key", F.get("ts", F.col("i"))).alias("key"), (F.col("i") + 1).alias("at")
        )
    return grown.select("key", "ref_id")


def valid_tokens(records: DataFrame) -> DataFrame:
    """Tokens of frequency above 1.5 times the mean."""
    return mean_gate(term_frequency(records), 1.5, True)


def combination_stage(records: DataFrame, k: int, by_key: bool) -> DataFrame:
    """One iteration: valid tokens, combinations, equal blocks deduplicated, then merged by shared records or key tokens."""
    blocks = cut(dedup_blocks(combination_blocks(records, valid_tokens(records), k)))
    return merge_sharing_key_tokens(blocks) if by_key else merge_sharing_records(blocks)


def iterative_combinations(records: DataFrame, max_k: int, by_key: bool) -> list[DataFrame]:
    """Blocks (key, ref_id) after k = 1, ..., max_k, with original record ids.

    From the second iteration on, the records are the blocks before and their tokens the members of these. Every
    iteration's members are resolved through the one before, so a block always lists original records.
    """
    original = records.select(F.col("ref_id").cast("string").alias("ref_id"), "tokens")
    lineage = original.select("ref_id", F.col("ref_id").alias("origin"))
    current, stages = original, []
    for k in range(1, max_k + 1):
        stage = cut(combination_stage(current, k, by_key))
        resolved = cut(stage.join(lineage, "ref_id").select("key", "origin").distinct())
        stages.append(resolved.select("key", F.col("origin").alias("ref_id")))
        pseudo = F.concat(F.lit("block_"), F.sha1(F.array_join("key", "\x1f")))
        current = stage.groupBy(pseudo.alias("ref_id")).agg(F.array_sort(F.collect_set("ref_id")).alias("tokens"))
        lineage = resolved.select(pseudo.alias("ref_id"), "origin").distinct()
        if stage.isEmpty():
            break
    return stages
