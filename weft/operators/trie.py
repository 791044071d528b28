"""Hierarchical blocking: the tree of binary splits by tokens in descending frequency.

A record's path is decided by which of the tokens, in rank order, it has. All groups are split in parallel, each by the first
token that some but not all of its members have, so a round replaces as many levels of the token list as hold no real
split for a group. As soon as a group is small (GROUP records), it is finished in one pass of its own: sorted by their ranks,
neighbouring records first differ at the rank of the split that parts them. Large groups go on splitting in parallel, for
ROUNDS rounds at most: a tree that is deeper than that above groups this large has more memberships than any store holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import dense_index
from weft.session import cut

STEP = "struct<token:string,present:int>"
GROUP, ROUNDS = 20_000, 64


def token_ranks(freq: DataFrame) -> DataFrame:
    """(token, rank): 0 for the most frequent token, ties by token."""
    return dense_index(freq.select("token", "freq"), [F.col("freq").desc(), F.col("token")], "rank").select("token", "rank")


def record_ranks(records: DataFrame, ranks: DataFrame) -> DataFrame:
    """(ref_id, ranks): ascending ranks of a record's tokens."""
    rows = records.select("ref_id", F.explode_outer(F.array_distinct("tokens")).alias("token")).join(ranks, "token", "left")
    return rows.groupBy("ref_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """All blocks below one group, as (path of (rank, present), ref_id); the group itself is not emitted."""
    rows = sorted(zip((tuple(r) for r in pdf["ranks"]), pdf["ref_id"]), key=lambda x: (x[0] + (1 << 60,), x[1]))
    out: list[tuple[list[int], object]] = []
    head = list(pdf["path"].iloc[0])
    work = [(0, len(rows), 0, head)]
    while work:
        lo, hi, depth, path = work.pop()
        if hi - lo < 2 or rows[lo][0] == rows[hi - 1][0]:
            continue
        # Sorted with the holder of a token first, a group's first real split lies where its ends part.
        first, last = rows[lo][0], rows[hi - 1][0]
        while depth < len(first) and depth < len(last) and first[depth] == last[depth]:
            depth += 1
        rank = first[depth]
        a, b = lo, hi
        while b - a > 1:
            middle = (a + b) // 2
            have = rows[middle][0]
            if depth < len(have) and have[depth] == rank:
                a = middle
            else:
                b = middle
        for left, right, present, at in ((lo, b, 1, depth + 1), (b, hi, 0, depth)):
            name = [*path, 2 * rank + present]
            out.extend((name, rows[k][1]) for k in range(left, right))
            work.append((left, right, at, name))
    return pd.DataFrame(out, columns=["path", "ref_id"])


def hierarchical_blocks(records: DataFrame, freq: DataFrame, group_size: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """(path, ref_id): every block of the tree (B11). path lists (token, present) of the real splits; the root's is empty."""
    ranks = cut(token_ranks(freq))
    kind = records.schema["ref_id"].dataType.simpleString()
    group = cut(record_ranks(records, ranks).withColumn("path", F.array().cast("array<long>")))
    levels = [group.select("path", "ref_id")]

    def finished(groups: DataFrame) -> DataFrame:
        return groups.groupBy("path").applyInPandas(_finish, f"path array<long>, ref_id {kind}")

    for _ in range(rounds):
        sizes = cut(group.groupBy("path").agg(F.count(F.lit(1)).alias("size")))
        large = sizes.where(F.col("size") > group_size)
        levels.append(finished(group.join(large, "path", "left_anti")))
        group = group.join(large.select("path"), "path", "left_semi")
        if large.isEmpty():
            break
        held = group.select("path", F.explode("ranks").alias("rank")).groupBy("path", "rank").agg(F.count(F.lit(1)).alias("n"))
        split = held.join(large, "path").where(F.col("n") < F.col("size")).groupBy("path").agg(F.min("rank").alias("rank"))
        parted = group.join(split, "path").withColumn(
            "path", F.array_append("path", 2 * F.col("rank") + F.array_contains("ranks", F.col("rank")).cast("int"))
        )
        group = cut(parted.select("ref_id", "ranks", "path"))
        levels.append(group.select("path", "ref_id"))
    else:
        levels.append(finished(group))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return _named(cut(every), ranks)


def _named(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranks in paths replaced by tokens; every distinct path is translated once."""
    paths = blocks.select("path").distinct()
    steps = paths.select("path", F.posexplode("path").alias("pos", "code"))
    read = steps.join(ranks, F.shiftright("code", 1) == F.col("rank"))
    step = F.struct("pos", "token", F.col("code").bitwiseAND(F.lit(1)).cast("int").alias("present"))
    names = read.groupBy("path").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    named = names.select("path", F.transform("steps", lambda s: F.struct(s["token"].alias("token"), s["present"].alias("present"))).alias("name"))
    return blocks.join(named, "path", "left").select(F.coalesce("name", F.array().cast(f"array<{STEP}>")).alias("path"), "ref_id")


def path_key(blocks: DataFrame) -> DataFrame:
    """(key, ref_id) for ranking and graphs: steps as token=1 or token=0."""
    return blocks.select(F.transform("path", lambda s: F.concat(s["token"], F.lit("="), s["present"].cast("string"))).alias("key"), "ref_id")
