"""Links among items that meet in slots, without trying all pairs of a crowded slot and without capping it.

Items are numbers, a slot is a key under which near items are likely to meet. Trying every pair of a slot is exact but costs the
square of its size, and a great group of near copies fills many slots. But only the classes that links make count, and members
that are connected already need not be tried against each other. So all members of a slot are first tried against its
smallest. Where this leaves members of a slot in different classes, and while pairs of these are many, members are tried against one
that is outside the slot's largest class, and so on; what that links grows that class. When the pairs of members of different
classes are few, or when this way makes them no fewer, all of them are tried. Hence no link between two classes is ever
missed, and a group of near copies costs about its size in each slot.

Items may carry a sketch, bits that tell strangers apart, so that a pair becomes a row and is verified only where the sketches allow it.
Members that bring one (64 bits that tell most strangers apart) are held against their slot's smallest where the slot is read, and
later inside the join. That alone may miss a link, with the chance that the caller's limit leaves to barely near pairs. Where whole
fingerprints would be too much for every slot, sketches are looked up for the items that the first round leaves; if they hold all
that verified asks, nothing is missed.

What is known of an item, its class and its sketch, is looked up once for the item, not for each of its slots.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.components import connected_components
from weft.session import cut, forget, one_row

#: Pairs to a member of a slot, on average, that are tried without more ado.
AFFORDED = 16


def crowded(slots: DataFrame) -> DataFrame:
    """(slot, pid, n, lead): the rows of slots that several items share, with their number and the smallest item; one shuffle.
    With a sketch in slots also sketch and lead_sketch."""
    own = Window.partitionBy("slot")
    columns = {"n": F.count(F.lit(1)).over(own), "lead": F.min("pid").over(own)}
    if "sketch" in slots.columns:
        columns["lead_sketch"] = F.min_by("sketch", "pid").over(own)
    return slots.withColumns(columns).where("n > 1")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs(a, b) with root_a, root_b, the classes of their ends so far."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("pid").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.withColumns({f"root_{end}": F.coalesce(f"root_{end}", end) for end in ("a", "b")})


def _grown(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Classes after links found(a, b) between some of them. Only these classes are looked at again, as nodes of a small graph."""
    if found.isEmpty():
        return roots
    between = cut(_rooted(found, roots).select("root_a", "root_b").distinct())
    merged = cut(connected_components(between, "root_a", "root_b").withColumnRenamed("root", "to"))
    alone = merged.select(F.col("node").alias("pid")).join(roots, "pid", "left_anti").select("pid", F.col("pid").alias("root"))
    moved = roots.unionByName(alone).join(merged, F.col("root") == F.col("node"), "left")
    grown = cut(moved.select("pid", F.coalesce("to", "root").alias("root")))
    for done in (between, merged, roots):
        forget(done)
    return grown


def _placed(members: DataFrame, roots: DataFrame, sketched: Callable[[DataFrame], DataFrame] = lambda items: items) -> DataFrame:
    """members(slot, pid) with root, the class of pid so far, and what sketched adds to items(pid, ...). Sketches that members bring stay."""
    brought = [F.min(c).alias(c) for c in members.columns if c == "sketch"]  # an item has one
    items = members.groupBy("pid").agg(F.collect_list("slot").alias("slots"), *brought).join(roots, "pid", "left")
    items = sketched(items.withColumn("root", F.coalesce("root", "pid")))
    return items.select(F.explode("slots").alias("slot"), *[c for c in items.columns if c != "slots"])


def connect(
    members: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    plausible: Callable[[Column, Column], Column] | None = None,
    sketched: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(pid, root): classes that links make of crowded members, without those of one; verified keeps the near ones of distinct
    pairs (a, b), a < b; plausible says of two sketches, which members bring or sketched adds to items(pid, ...), whether
    their pair needs to be tried."""
    brought = [c for c in members.columns if c == "sketch"]
    sketch = ["sketch"] if plausible else []

    def allowed(x: str, y: str) -> Column:
        return plausible(F.col(x), F.col(y)) if plausible else F.lit(True)

    members = cut(members)
    tried = members.where(F.col("pid") != F.col("lead"))
    tried = (tried.where(allowed("sketch", "lead_sketch")) if brought else tried).select(F.col("lead").alias("a"), F.col("pid").alias("b"))
    links = cut(verified(tried.distinct()).select("a", "b"))
    roots = cut(connected_components(links).select(F.col("node").alias("pid"), "root"))
    # All have met their slot's smallest. What is left are slots whose other members are of several classes.
    slot = Window.partitionBy("slot")
    others = _placed(members.where("n > 2 AND pid != lead").select("slot", "pid", *brought), roots)
    mixed = others.withColumns({"least": F.min("root").over(slot), "most": F.max("root").over(slot)}).where("least < most")
    every, members = members, cut(mixed.select("slot", "pid", *brought))
    for done in (every, links):
        forget(done)
    turn, before = 0, math.inf
    while True:
        rows = _placed(members, roots, *([sketched] if sketched else [])).withColumn("n", F.count(F.lit(1)).over(slot))
        # Of each slot the largest class so far, and how many members are outside it.
        rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("slot", "root"))).withColumn("top", F.max(F.struct("size", "root")).over(slot))
        rows = cut(rows.where(F.col("n") > F.col("top.size")).select("slot", "pid", "root", F.col("top.root").alias("most"), "n", *sketch))
        total = one_row(rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("root") != F.col("most"), F.col("n"))).alias("pairs")))
        if not total["rows"]:
            return roots
        other = rows.where(F.col("root") != F.col("most")).select(
            "slot", F.col("pid").alias("b"), F.col("root").alias("other"), *[F.col(c).alias("other_sketch") for c in sketch]
        )
        last = total["pairs"] <= AFFORDED * total["rows"] or total["pairs"] > before / 2  # few, or as few as this way makes them
        if not last:
            lead = other.groupBy("slot").agg(F.min_by(F.struct("b", "other", *[f"other_{c}" for c in sketch]), F.xxhash64("b", F.lit(turn))).alias("next"))
            other = lead.select("slot", "next.*")
        met = rows.join(other, "slot").where(F.col("root") != F.col("other")).where(allowed("sketch", "other_sketch"))
        if last:
            met = met.where((F.col("root") == F.col("most")) | (F.col("pid") < F.col("b")))
        found = cut(verified(met.select(F.least("pid", "b").alias("a"), F.greatest("pid", "b").alias("b")).distinct()).select("a", "b"))
        roots, turn, before = _grown(roots, found), turn + 1, total["pairs"]
        for done in (rows, found):
            forget(done)
        if last:
            return roots
