"""Operations on sets of blocks, rows (key, ref_id) with key an array of strings.

Two blocks have equal members if their counts and two 64-bit exclusive-or hashes over the members agree; comparing these
fingerprints replaces collecting and comparing sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import key_mean_length, key_size, pair_count
from weft.session import cut

PRINT = ("size", "x", "y")


def block_prints(blocks: DataFrame) -> DataFrame:
    """(key, size, x, y): member fingerprints."""
    return blocks.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("ref_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "ref_id")).alias("y")
    )


def block_sizes(blocks: DataFrame) -> DataFrame:
    """(key, size)."""
    return blocks.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def key_order() -> Column:
    """Total order of keys: fewer tokens first, then by content."""
    return F.struct(F.size("key").alias("n"), F.col("key").alias("key"))


def merge_identical(blocks: DataFrame) -> DataFrame:
    """Blocks of equal members become one, keyed by the sorted union of their keys."""
    prints = block_prints(blocks)
    united = prints.groupBy(*PRINT).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("key")))).alias("merged"), F.min_by("key", key_order()).alias("key")
    )
    return blocks.join(united.select("key", "merged"), "key").select(F.col("merged").alias("key"), "ref_id")


def dedup_blocks(blocks: DataFrame) -> DataFrame:
    """Of blocks with equal members the one with the first key (fewest tokens, then content) stays."""
    first = block_prints(blocks).groupBy(*PRINT).agg(F.min_by("key", key_order()).alias("key"))
    return blocks.join(first.select("key"), "key", "left_semi").select("key", "ref_id")


#: Bits of the member mask that a block is first compared by, 64 to a column.
MASK = 256


def block_masks(blocks: DataFrame) -> DataFrame:
    """(key, size, m0, m1, ...): a bit for the hash of every member; a subset's bits are among its superset's."""
    at = F.pmod(F.xxhash64(F.lit("mask"), "ref_id"), F.lit(MASK))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = [F.bit_or(F.when(F.floor(at / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(MASK // 64)]
    return blocks.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *words)


def purge_subsets(blocks: DataFrame) -> DataFrame:
    """Blocks that no other block contains; of equal blocks the one with the first key stays.

    A superset of a block shares its rarest member, so candidates come from the blocks of that one member only. Masks of
    all members, made on the map side, refute nearly all of them in the row; the rest are confirmed by counting shared members.
    """
    unique = cut(dedup_blocks(blocks))
    masks = [f"m{w}" for w in range(MASK // 64)]
    known = unique.join(block_masks(unique), "key")
    rarity = unique.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"))
    pivots = known.join(rarity, "ref_id").groupBy("key", "size", *masks).agg(F.min_by("ref_id", F.struct("n", "ref_id")).alias("ref_id"))
    larger = known.select("ref_id", F.col("key").alias("super"), F.col("size").alias("super_size"), *[F.col(m).alias(f"super_{m}") for m in masks])
    fits = F.col("super_size") > F.col("size")
    for m in masks:
        fits = fits & (F.col(m).bitwiseAND(F.bitwise_not(F.col(f"super_{m}"))) == 0)
    candidates = cut(pivots.join(larger, "ref_id").where(fits).select("key", "size", "super"))
    held = candidates.join(unique, "key").join(unique.withColumnRenamed("key", "super"), ["super", "ref_id"])
    contained = held.groupBy("key", "super", "size").agg(F.count(F.lit(1)).alias("shared")).where("shared = size").select("key").distinct()
    return unique.join(contained, "key", "left_anti").select("key", "ref_id")


def union_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks of both; equal keys are one block."""
    return old.unionByName(new).distinct()


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct pairs that share a block."""
    left = blocks.select("key", F.col("ref_id").alias("a"))
    right = blocks.select("key", F.col("ref_id").alias("b"))
    return left.join(right, "key").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def pair_total(blocks: DataFrame) -> DataFrame:
    """One row (n_blocks, n_pairs): pairs counted once per block, by arithmetic."""
    return block_sizes(blocks).agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum(pair_count("size")), F.lit(0)).alias("n_pairs"))


def top_k(
    blocks: DataFrame, k: int = 3, min_block_size: int = 2, mode: str = "size", weight_size: float = 0.0, weight_shared: float = 0.0,
    weight_tokenlen: float = 0.0,
) -> DataFrame:
    """Every record stays in its k best blocks; blocks left with fewer than min_block_size members go.

    Modes rank by size, by size per key token (specificity), by longest key (keylen), or by a weighted sum of
    min-max normalised criteria (composite). Ties end with the key, so the order is total.
    """
    stats = block_sizes(blocks).select("key", "size", key_size("key").alias("klen"), key_mean_length("key").alias("tlen"))
    if mode == "size":
        order = ["size"]
    elif mode == "specificity":
        order = [F.col("size") / F.greatest("klen", F.lit(1)), -F.col("klen"), "size"]
    elif mode == "keylen":
        order = [-F.col("klen"), "size"]
    elif mode == "composite":
        if weight_size <= 0 and weight_shared <= 0 and weight_tokenlen <= 0:
            raise ValueError("composite needs a positive weight")
        spans = stats.agg(*[f(c).alias(f"{c}_{n}") for c in ("size", "klen", "tlen") for f, n in ((F.min, "lo"), (F.max, "hi"))])
        stats = stats.crossJoin(F.broadcast(spans))  # one row

        def norm(c: str) -> Column:
            span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
            return F.when(span == 0, 0.0).otherwise((F.col(c) - F.col(f"{c}_lo")) / span)

        parts = [(weight_size, norm("size")), (weight_shared, 1.0 - norm("klen")), (weight_tokenlen, 1.0 - norm("tlen"))]
        score = sum((F.lit(float(w)) * part for w, part in parts if w > 0), F.lit(0.0))
        stats = stats.withColumn("score", F.round(score, 12))
        order = ["score", "size", -F.col("klen")]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    ranked = blocks.join(stats, "key").withColumn("rank", F.row_number().over(Window.partitionBy("ref_id").orderBy(*order, "key")))
    kept = ranked.where(F.col("rank") <= k).select("key", "ref_id")
    return kept.join(block_sizes(kept).where(F.col("size") >= min_block_size).select("key"), "key", "left_semi")
