"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation again after every turn. A rolling hash over a conversation's turns (the exclusive or of
two 64-bit hashes of each turn with its position) names every turn prefix. A conversation whose own hash is a proper
prefix of another's is a snapshot of it and goes, by an anti-join on (length, hash); of equal conversations the one of
smallest id stays and counts the copies. What is left is maximal and is rendered. Only ids and hashes are shuffled to
decide; texts are shuffled once, those of retained conversations, and prefixes are made distinct on the map side first, so
a first turn that everyone shares costs no more than any other.

Defined cases: turns are ordered by number, null first, equal numbers by content; repeated rows are repeated turns. A
null role reads "unknown", a null text is empty. A row without a conversation id is a conversation of its own, with rows
of the same content. An empty table gives an empty result. Turn markers inside a text are broken up, so that a
rendered text parses only one way. Other columns are not read. A conversation is one row of the result, so the largest
one must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(text: str) -> Column:
    """Blanks inside the brackets of markers that a text spells out."""
    return F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def normalise(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(key, conv, turn, role, text, h1, h2): defaults filled, two hashes of each turn's content."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    base = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    hashed = base.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role")})
    own = F.concat(F.lit("-:"), F.hex("h1"), F.hex("h2"))
    return hashed.withColumn("key", F.coalesce(F.concat(F.lit("+:"), F.col("conv").cast("string")), own))


def maximal(turns: DataFrame) -> DataFrame:
    """(key, n_turns, n_copies) of the conversations to keep, from normalised turns."""
    by = Window.partitionBy("key").orderBy("turn", "h1", "h2")
    placed = turns.select("key", "conv", "turn", "h1", "h2").withColumns({"k": F.row_number().over(by)})
    mixed = placed.withColumns({"m1": F.xxhash64("k", "h1", "h2"), "m2": F.xxhash64("h2", "k", "h1")})
    running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = cut(
        mixed.select(
            "key", "conv", "k", F.bit_xor("m1").over(running).alias("p1"), F.bit_xor("m2").over(running).alias("p2"),
            F.lead("k").over(by).isNull().alias("last"),
        )
    )
    whole = prefixes.where("last").groupBy("k", "p1", "p2").agg(F.min(F.struct("conv", "key")).alias("kept"), F.count(F.lit(1)).alias("n_copies"))
    proper = prefixes.where("NOT last").select("k", "p1", "p2").distinct()
    left = whole.join(proper, ["k", "p1", "p2"], "left_anti")
    return left.select(F.col("kept.key").alias("key"), F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(key, conv, n_turns, n_copies, text): the template over the turns of retained conversations."""
    chosen = turns.join(kept.select("key"), "key", "left_semi")
    listed = chosen.groupBy("key").agg(
        F.min("conv").alias("conv"),
        F.array_sort(F.collect_list(F.struct("turn", "h1", "h2", F.replace("role", F.lit("<|"), F.lit("< |")).alias("role"), _clean("text").alias("text")))).alias("ts"),
    )
    text = F.array_join(
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE), F.lit("\n"))), ""
    )
    return listed.select("key", "conv", text.alias("text")).join(kept, "key")


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per maximal conversation: id, n_turns, n_copies (equal conversations), rendered text."""
    plain = normalise(turns, conv_col, turn_col, role_col, text_col)
    kept = cut(maximal(plain))
    return render(plain, kept).select(F.col("conv").alias(conv_col), "n_turns", "n_copies", "text")


ORACLE = """
WITH t AS (
    SELECT conv_id, list({'r': coalesce(role, 'unknown'), 'x': coalesce(text, '')} ORDER BY turn) AS l
    FROM conversations GROUP BY conv_id),
f AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM t GROUP BY l),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM t)),
kept AS (SELECT f.* FROM f ANTI JOIN p ON f.l = p.l),
turns AS (SELECT conv_id, n_copies, l, unnest(range(1, len(l) + 1)) AS k FROM kept)
SELECT conv_id, max(len(l)) AS n_turns, max(n_copies) AS n_copies,
    string_agg('<|im_start|>' || replace(l[k].r, '<|', '< |') || chr(10) || replace(l[k].x, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM turns GROUP BY conv_id
"""
