"""Connected components by alternating large-star and small-star steps.

Each step is a map-side combined minimum per node followed by a join of the edges with these minima, so a node of
any degree costs its own machine no more than its share: the aggregate combines before the shuffle, and the join is an
ordinary shuffled join that adaptive execution splits where one node holds many edges. Every round is checkpointed, and the one
before then deleted.
Nothing but two scalars per round (edge count and a hash of the edge set) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import cut, forget, one_row


def _hop(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step on distinct edges (hi, lo) with hi > lo."""
    down = edges.select(F.col("hi").alias("node"), F.col("lo").alias("other"))
    if keep_larger:
        both = down.unionByName(edges.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        moved = both.join(least, "node").where(F.col("other") > F.col("node"))
        out = moved.select(F.col("other").alias("hi"), F.col("m").alias("lo"))
    else:
        least = down.groupBy("node").agg(F.min("other").alias("m"))
        joined = down.join(least, "node")
        out = joined.select(F.col("other").alias("hi"), F.col("m").alias("lo")).unionByName(
            least.select(F.col("node").alias("hi"), F.col("m").alias("lo"))
        )
    return out.where(F.col("hi") > F.col("lo")).distinct()


def _state(edges: DataFrame) -> tuple:
    state = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"), F.bit_xor(F.hash("hi", "lo")).alias("y")
    )
    return tuple(one_row(state))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node reachable.

    Self-loops yield their node as its own root. Edges with a null end are ignored. Raises if max_rounds rounds
    (each one large and one small star; their number grows with the logarithm of the graph) do not converge.
    """
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    clean = cut(clean.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    loops = clean.where(F.col("hi") == F.col("lo")).select(F.col("hi").alias("node"))
    current = clean.where(F.col("hi") > F.col("lo"))
    before = _state(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, current = current, cut(_hop(_hop(current, True), False))
        forget(last)
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    members = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    stars = members.unionByName(roots)
    return stars.unionByName(loops.join(stars, "node", "left_anti").select("node", F.col("node").alias("root")))
