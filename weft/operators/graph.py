"""Weighted pair graphs and clusters.

An edge's weight is the sum over shared blocks of a per-block contribution, scaled by the records' Jaccard similarity. The similarity
does not depend on the block, so it is computed once per pair after the sum, not once per block and pair. Blocks
above a pair budget are left out before the self-join, whose cost is the sum of squared block sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import jaccard, key_length_score, key_type_factor, pair_count
from weft.operators.blocks import block_sizes
from weft.operators.components import connected_components
from weft.session import cut


@dataclass(frozen=True)
class ArcsFactors:
    """Multipliers of a block's contribution; pair_sim_weight blends a pair's Jaccard similarity in."""

    length_weight: float = 0.0
    numeric_factor: float = 1.0
    word_factor: float = 1.0
    density_weight: float = 0.0
    density_sample_cap: int = 200
    pair_sim_weight: float = 1.0


def _token_sets(records: DataFrame) -> DataFrame:
    return records.select("ref_id", F.array_distinct("tokens").alias("tokens"))


def pair_similarity(pairs: DataFrame, records: DataFrame, both_empty: float = 0.0) -> DataFrame:
    """pairs(a, b, ...) with jaccard, the similarity of the records' token sets."""
    sets = _token_sets(records)
    left = sets.select(F.col("ref_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("ref_id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").withColumn("jaccard", jaccard(F.col("ta"), F.col("tb"), both_empty)).drop("ta", "tb")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(key, a, b), a < b: pairs per block."""
    left = blocks.select("key", F.col("ref_id").alias("a"))
    right = blocks.select("key", F.col("ref_id").alias("b"))
    return left.join(right, "key").where(F.col("a") < F.col("b"))


def sampled_pairs(blocks: DataFrame, sample_cap: int = 200) -> DataFrame:
    """(key, a, b): sample_cap pairs of every block, all pairs of a block that has no more.

    Members are numbered by a hash; pair p of members i < j has the number p = j (j - 1) / 2 + i, and equally spaced numbers
    are drawn. So at most sample_cap rows a block are made, not the square of its size.
    """
    order = Window.partitionBy("key").orderBy(F.md5(F.col("ref_id").cast("string")), "ref_id")
    placed = blocks.select("key", "ref_id", (F.row_number().over(order) - 1).cast("long").alias("i"))
    total = pair_count("size")
    drawn = F.least(total, F.lit(sample_cap).cast("long"))
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), drawn - 1), lambda k: F.floor(k * total / drawn).cast("long"))
    picked = block_sizes(blocks).where("size > 1").select("key", F.explode(numbers).alias("p"))
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    pairs = picked.withColumn("j", j).withColumn("i", F.col("p") - F.col("j") * (F.col("j") - 1) / 2)
    pairs = pairs.select("key", F.col("i").cast("long").alias("i"), "j")
    first = pairs.join(placed.withColumnRenamed("ref_id", "x"), ["key", "i"]).select("key", F.col("j").alias("i"), "x")
    both = first.join(placed.withColumnRenamed("ref_id", "y"), ["key", "i"])
    return both.select("key", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def block_density(blocks: DataFrame, records: DataFrame, sample_cap: int = 200) -> DataFrame:
    """(key, density): mean similarity over a block's pairs; of larger blocks over sample_cap pairs by hash order."""
    return pair_similarity(sampled_pairs(blocks, sample_cap), records).groupBy("key").agg(F.avg("jaccard").alias("density"))


def contributions(
    blocks: DataFrame, records: DataFrame | None, weighting: str = "uniform", corpus_size: int | None = None,
    max_block_pair_cost: int | None = None, factors: ArcsFactors = ArcsFactors(),
) -> DataFrame:
    """(key, c): the contribution of every block of at least two members to each of its pairs."""
    size = F.col("size")
    sizes = block_sizes(blocks).where(size >= 2)
    if max_block_pair_cost is not None:
        sizes = sizes.where(pair_count("size") <= max_block_pair_cost)
    if weighting == "idf":
        value: Column = F.when(size >= (corpus_size or 0), 0.0).otherwise(F.log(F.lit(float(corpus_size or 1)) / size) / size)
    elif weighting == "uniform":
        value = 1.0 / size
    else:
        raise ValueError(f"unknown weighting {weighting!r}")
    value = value * key_length_score("key", factors.length_weight) * key_type_factor("key", factors.numeric_factor, factors.word_factor)
    if factors.density_weight != 0.0:
        if records is None:
            raise ValueError("density needs records")
        sizes = sizes.join(block_density(blocks.join(sizes.select("key"), "key", "left_semi"), records, factors.density_sample_cap), "key", "left")
        value = value * (1.0 + factors.density_weight * F.coalesce("density", F.lit(0.0)))
    return sizes.select("key", value.alias("c")).where(F.col("c") != 0)


def arcs_graph(
    blocks: DataFrame, records: DataFrame, weighting: str = "uniform", corpus_size: int | None = None,
    max_block_pair_cost: int | None = None, factors: ArcsFactors = ArcsFactors(), least: float | None = None,
) -> DataFrame:
    """(a, b, w), a < b: summed contributions of shared blocks, times (1 - s) + s * jaccard for s = pair_sim_weight.

    With least, only edges of that weight or more (to nine decimals). As the similarity can only lower a weight, sums below it
    go before any record's tokens are sent to an edge.
    """
    weights = contributions(blocks, records, weighting, corpus_size, max_block_pair_cost, factors)
    members = blocks.join(weights, "key")
    left = members.select("key", F.col("ref_id").alias("a"), "c")
    right = members.select("key", F.col("ref_id").alias("b"))
    edges = left.join(right, "key").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum("c").alias("w"))
    strong = F.lit(True) if least is None else F.round("w", 9) >= least
    edges = edges.where(strong)
    s = factors.pair_sim_weight
    if s <= 0:
        return edges
    similar = pair_similarity(edges, records)
    return similar.select("a", "b", (F.col("w") * (1.0 - s + s * F.col("jaccard"))).alias("w")).where(strong)


def edge_histogram(edges: DataFrame, buckets: int = 10) -> DataFrame:
    """(bucket, lo, n): edges by weight in equally wide buckets, the last one closed; one bucket if all weights are equal."""
    ends = edges.agg(F.min("w").alias("first"), F.max("w").alias("last"))
    width = (F.col("last") - F.col("first")) / buckets
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("w") - F.col("first")) / width), F.lit(buckets - 1)))
    placed = edges.crossJoin(F.broadcast(ends)).select(at.cast("int").alias("bucket"), "first", width.alias("width"))  # one row
    return placed.groupBy("bucket", "first", "width").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", (F.col("first") + F.col("bucket") * F.col("width")).alias("lo"), "n"
    )


def number_clusters(members: DataFrame) -> DataFrame:
    """(ref_id, cluster_id) from (ref_id, root): ids by size descending, then smallest member.

    Ranks come from a sort of clusters of two or more, distributed by range, and single records follow in order; the ranks of
    ranges are offset by the sizes of the ranges before them (one small row each).
    """
    sized = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("ref_id").alias("first"))
    ranked = dense_index(sized, [F.col("size").desc(), F.col("first")], "cluster_id")
    return members.join(ranked.select("root", "cluster_id"), "root").select("ref_id", "cluster_id")


def dense_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 0, 1, 2, ... in a total order, without sending all rows to one task."""
    sorted_rows = cut(df.sort(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("__part"), before.alias("__before"))  # a row per partition
    placed = sorted_rows.withColumns({"__p": part, "__k": place}).join(F.broadcast(offsets), F.col("__p") == F.col("__part"))
    return placed.withColumn(name, (F.col("__before") + F.col("__k")).cast("long")).select(*df.columns, name)


def label_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref_id, root) for all ids; those without an edge are their own root."""
    roots = connected_components(edges).select(F.col("node").alias("ref_id"), "root")
    return ids.join(roots, "ref_id", "left").select("ref_id", F.coalesce("root", "ref_id").alias("root"))


def split_by_density(clusters: DataFrame, edges: DataFrame, density_floor: float, min_size: int = 3) -> DataFrame:
    """(ref_id, root) with clusters split whose share of realised edges is below the floor.

    The lightest edges go, by (w, a, b), until the cluster falls apart; then its parts are judged. Only clusters that are
    too sparse are gathered, each with its own edges; their size bounds a task's memory.
    """
    inside = edges.join(clusters.select(F.col("ref_id").alias("a"), "root"), "a")
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    counts = inside.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    sparse = sizes.join(counts, "root").where((F.col("size") >= min_size) & (F.col("m") / pair_count("size") < density_floor)).select("root")
    kind = clusters.schema["ref_id"].dataType.simpleString()

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = _split(list(zip(pdf["w"], pdf["a"], pdf["b"])), density_floor, min_size)
        return pd.DataFrame([(member, min(piece)) for piece in pieces for member in piece], columns=["ref_id", "root"])

    found = inside.join(sparse, "root").select("root", "a", "b", "w").groupBy("root").applyInPandas(split, f"ref_id {kind}, root {kind}")
    return clusters.join(sparse, "root", "left_anti").select("ref_id", "root").unionByName(found)


def _parts(nodes: set, edges: list[tuple]) -> list[set]:
    parent = {n: n for n in nodes}

    def find(x: object) -> object:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for _, a, b in edges:
        parent[find(a)] = find(b)
    groups: dict = {}
    for n in nodes:
        groups.setdefault(find(n), set()).add(n)
    return list(groups.values())


def _split(edges: list[tuple], floor: float, least: int) -> Iterator[set]:
    """Parts of one connected cluster. Adding edges from the heaviest down, the cluster becomes connected with the edge
    whose removal (after all lighter ones) first disconnects it, so one pass finds where to cut."""
    work = [({x for _, a, b in edges for x in (a, b)}, sorted(edges))]
    while work:
        nodes, inner = work.pop()
        n = len(nodes)
        if n < least or not inner or len(inner) / (n * (n - 1) // 2) >= floor:
            yield nodes
            continue
        parent = {x: x for x in nodes}

        def find(x: object) -> object:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left, at = n, len(inner)
        while left > 1 and at > 0:
            at -= 1
            _, a, b = inner[at]
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[ra] = rb
                left -= 1
        surviving = inner[at + 1 :]
        for part in _parts(nodes, surviving):
            work.append((part, [e for e in surviving if e[1] in part]))


def cluster_records(
    blocks: DataFrame, records: DataFrame, tau: float = 1.0, weighting: str = "uniform", density_floor: float = 0.0,
    density_min_size: int = 3, max_block_pair_cost: int | None = None, factors: ArcsFactors = ArcsFactors(),
) -> DataFrame:
    """(ref_id, root): components of the edges of weight tau or more, all records kept, sparse ones split."""
    corpus = records.count() if weighting == "idf" else None
    kept = cut(arcs_graph(blocks, records, weighting, corpus, max_block_pair_cost, factors, tau))
    clusters = label_components(records.select("ref_id"), kept.select("a", "b"))
    return split_by_density(cut(clusters), kept, density_floor, density_min_size) if density_floor > 0 else clusters


