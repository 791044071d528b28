"""Token statistics, frequency gates and parameters derived from them.

Frequencies are grouped aggregations that combine on the map side. Joining occurrences with frequencies shuffles on the token;
a frequent token's rows are split by adaptive execution, and gates with an upper bound drop it by the join itself.

Records are rows (ref_id, tokens). Rows that share an id, or have none, count as records of their own here; the blocks made of
them then repeat the id, and pairs, which need a < b, leave null ids out. A reader that must keep one row per id says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import is_number
from weft.operators.lists import held, without
from weft.session import cut


def _exploded(records: DataFrame, tokens: Column) -> DataFrame:
    # An inner explode would make the optimizer test the list for emptiness first, and so split every text twice.
    return records.select("ref_id", F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull())


def occurrences(records: DataFrame) -> DataFrame:
    """(ref_id, token): one row per token of a record, repeats included."""
    return _exploded(records, F.col("tokens"))


def distinct_tokens(records: DataFrame) -> DataFrame:
    """(ref_id, token): one row per distinct token of a record; no shuffle."""
    return _exploded(records, F.array_distinct("tokens"))


def term_frequency(records: DataFrame) -> DataFrame:
    """(token, freq): occurrences."""
    return occurrences(records).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def document_frequency(records: DataFrame) -> DataFrame:
    """(token, freq): records that have the token."""
    return distinct_tokens(records).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def frequencies(records: DataFrame, kind: str = "tf") -> DataFrame:
    return {"tf": term_frequency, "df": document_frequency}[kind](records)


def token_statistics(records: DataFrame) -> DataFrame:
    """(token, tf, df): a record's repeats are counted where it is read, so the shuffle has a row per record and token at most."""
    per_record = occurrences(records).groupBy("ref_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per_record.groupBy("token").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def remove_tokens(records: DataFrame, dropped: DataFrame) -> DataFrame:
    """records without the tokens of dropped(token); records that lose all keep an empty list. Order and repeats stay.

    Every row is changed by itself, whatever ids others have: rows of equal or null ids stay apart, in number and content. A dropped
    table that is small once counted is looked up in the row; a larger one is joined on the token, rows being numbered first.
    """
    dropped = cut(dropped.select("token"))
    gone = held(dropped)
    if gone is not None:
        return records.select("ref_id", without(records, F.col("tokens"), [r["token"] for r in gone]).alias("tokens"))
    kept = placed_tokens(records).join(dropped.withColumn("gone", F.lit(True)), "token", "left")
    return regrouped(kept, F.when(F.col("gone").isNull(), F.col("token")))


def placed_tokens(records: DataFrame) -> DataFrame:
    """(row, ref_id, pos, token): one row per token, by a row number that survives recomputation."""
    rows = cut(records.select(F.monotonically_increasing_id().alias("row"), "ref_id", "tokens"))
    return rows.select("row", "ref_id", F.posexplode_outer("tokens").alias("pos", "token"))


def regrouped(placed: DataFrame, token: Column) -> DataFrame:
    """(ref_id, tokens) from placed rows, tokens in order, null ones left out."""
    listed = F.array_sort(F.collect_list(F.when(token.isNotNull(), F.struct("pos", token.alias("token")))))
    grouped = placed.groupBy("row").agg(F.first("ref_id").alias("ref_id"), listed.alias("ts"))
    return grouped.select("ref_id", F.transform("ts", lambda t: t["token"]).alias("tokens"))


def remove_frequent_tokens(records: DataFrame, freq: DataFrame, max_frequency: int = 60) -> DataFrame:
    """Records without tokens of frequency above max_frequency."""
    return remove_tokens(records, frequent_tokens(freq, max_frequency))


def frequent_tokens(freq: DataFrame, max_frequency: int = 60) -> DataFrame:
    return freq.where(F.col("freq") > max_frequency)


def rank_value(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row (value): the element at floor(n * share), at most the last, of the ascending list; 0 for none.

    Found from counts per distinct value, not by sorting the rows.
    """
    counts = df.groupBy(F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # Distinct frequencies of a corpus are few (they grow with the square root of its size), so one task can sum them up.
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("vs")).crossJoin(total)
    wanted = F.least(F.floor(F.col("total") * share), F.col("total") - 1)
    state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
    walked = F.aggregate(
        "vs", state,
        lambda s, x: F.struct(
            (s["seen"] + x["n"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["n"] > wanted), x["v"]).otherwise(s["v"]).alias("v")
        ),
    )
    return listed.select(F.coalesce(walked["v"], F.lit(0)).alias(value))


def frequency_cap(freq: DataFrame, percentile: float = 0.95) -> DataFrame:
    """One row (freq): the frequency cap of seed tokens."""
    return rank_value(freq, "freq", percentile)


def record_length(records: DataFrame) -> DataFrame:
    return records.select(F.size(F.array_distinct("tokens")).cast("long").alias("n"))


def mode_length(records: DataFrame) -> DataFrame:
    """One row (mode): the most common number of distinct tokens, the smallest on ties."""
    counts = record_length(records).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.max_by("n", F.struct("c", -F.col("n"))).alias("mode"))


def stop_k(records: DataFrame, factor: float = 0.6) -> DataFrame:
    """One row (stop_k): floor(factor * mode of the record length)."""
    return mode_length(records).select(F.floor(F.col("mode") * factor).alias("stop_k"))


def mean_gate(freq: DataFrame, factor: float, strict: bool) -> DataFrame:
    """freq rows at (strictly) above factor times the mean frequency."""
    bound = freq.agg((F.avg("freq") * factor).alias("bound"))
    test = F.col("freq") > F.col("bound") if strict else F.col("freq") >= F.col("bound")
    return freq.join(F.broadcast(bound), test).drop("bound")  # one row is broadcast


def gate(token: Column, freq: Column, cap: Column | int | None, min_length: int, exclude_numeric: bool, full: bool) -> Column:
    """Which gate a token meets first: too_short, numeric, too_rare, too_frequent or kept."""
    rare = freq < 2
    if full:
        return F.when(rare, "too_rare").otherwise("kept")
    out = F.when(F.char_length(token) < min_length, "too_short")
    if exclude_numeric:
        out = out.when(is_number(token), "numeric")
    out = out.when(rare, "too_rare")
    if cap is not None:
        out = out.when(freq > cap, "too_frequent")
    return out.otherwise("kept")
