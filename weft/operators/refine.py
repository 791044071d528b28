"""Recursive refinement of blocks.

Refining extends a block by a token that enough of its members share. A block of key K holds exactly the records that
have all of K, so plain recursion is frequent-itemset mining and runs level by level: only the blocks that the previous level
made are extended, each level is checkpointed, and nothing reaches the driver but whether a level is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.blocks import block_sizes, dedup_blocks, merge_identical, purge_subsets, union_blocks
from weft.operators.tokens import distinct_tokens
from weft.session import cut


def refine_blocks(blocks: DataFrame, records: DataFrame, floor: int) -> DataFrame:
    """One level: blocks keyed by K and one more token that at least floor members have.

    The frequency of a token inside a block is the size of the block it makes, so blocks are extended first and
    those that stay too small are dropped by a count.
    """
    tokens = distinct_tokens(records)
    wider = blocks.join(tokens, "ref_id").where(~F.array_contains("key", F.col("token")))
    made = wider.select(F.array_sort(F.array_append("key", F.col("token"))).alias("key"), "ref_id").distinct()
    large = block_sizes(made).where(F.col("size") >= floor).select("key")
    return made.join(large, "key", "left_semi").select("key", "ref_id")


@dataclass(frozen=True)
class Refined:
    """The last snapshot, and the one with most blocks (the first of equals), with its depth."""

    blocks: DataFrame
    peak: DataFrame
    peak_depth: int
    peak_size: int


def _count(blocks: DataFrame) -> int:
    return blocks.select("key").distinct().count()


def recursive_blocking(
    blocks: DataFrame, records: DataFrame, max_depth: int, min_intra_freq: int = 2, merge: bool = True, purge: bool = True
) -> Refined:
    """Refinement to max_depth with a floor of max(depth, min_intra_freq), keeping old and new blocks.

    With merge, blocks of equal members are united after each level, with purge contained ones go. Stops early when
    a level gives nothing, or changes nothing (floors only rise, so no later level would). Purging without merging needs no
    levels at all (see purged_recursion), and its blocks are never more than the seeds, so these are the peak.
    """
    current = cut(blocks)
    frontier = current
    size = _count(current)
    if purge and not merge:
        return Refined(cut(purged_recursion(current, records, max_depth, min_intra_freq)), current, 0, size)
    peak, peak_depth, peak_size = current, 0, size
    for depth in range(1, max_depth + 1):
        new = cut(refine_blocks(frontier, records, max(depth, min_intra_freq)))
        if new.isEmpty():
            break
        grown = union_blocks(current, new)
        if merge:
            grown = merge_identical(grown)
        if purge:
            grown = purge_subsets(grown)
        grown = cut(grown)
        size = _count(grown)
        if size > peak_size:
            peak, peak_depth, peak_size = grown, depth, size
        if not merge and not purge:
            fresh = new.join(current.select("key").distinct(), "key", "left_anti").select("key", "ref_id")
            frontier = cut(fresh)
            done = frontier.isEmpty()
        else:
            frontier = grown
            changed = block_sizes(grown).join(block_sizes(current), ["key", "size"], "left_anti")
            done = changed.isEmpty()
        current = grown
        if done:
            break
    return Refined(current, peak, peak_depth, peak_size)


def purged_recursion(blocks: DataFrame, records: DataFrame, max_depth: int, min_intra_freq: int = 2) -> DataFrame:
    """The members left by recursion with purge, without recursing: children lie inside their parents, so purging
    keeps exactly the maximal seeds. Where no level ever runs (depth 0, or nothing refines) seeds stay as they are."""
    if max_depth < 1 or refine_blocks(blocks, records, max(1, min_intra_freq)).isEmpty():
        return blocks
    return purge_subsets(blocks)


def falling_floor(blocks: DataFrame, records: DataFrame, beta: int, keep: bool = False) -> DataFrame:
    """Refinement with floors beta, beta - 1, ..., 2 (B6); with keep, old blocks stay and equal ones are deduplicated."""
    current = cut(blocks)
    for floor in range(beta, 1, -1):
        new = cut(refine_blocks(current, records, floor))
        if new.isEmpty():
            break
        current = cut(dedup_blocks(union_blocks(current, new))) if keep else new
    return current


def rising_floor(blocks: DataFrame, records: DataFrame, stop_k: int, first: int = 1) -> DataFrame:
    """Refinement with floors first, ..., stop_k, keeping old blocks and deduplicating equal ones."""
    current = cut(blocks)
    for floor in range(first, stop_k + 1):
        new = cut(refine_blocks(current, records, floor))
        if new.isEmpty():
            break
        current = cut(dedup_blocks(union_blocks(current, new)))
    return current
