"""Global spelling correction: rare tokens become frequent ones at edit distance one.

Tokens within one insertion, deletion, substitution or exchange of neighbours share a string with at most one character
left out. So candidates meet in an equi-join on these shortened strings, not in a product of the vocabulary with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import adjacent_swap
from weft.operators.lists import held, replaced
from weft.operators.tokens import placed_tokens, regrouped
from weft.session import cut


def shortened(word: Column) -> Column:
    """The word and all strings with one character left out."""
    n = F.char_length(word)
    cut_at = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.array_append(cut_at, word))


def clean_index(freq: DataFrame, words: DataFrame | None, min_length: int, max_freq_err: int) -> DataFrame:
    """(token, freq): words of letters, long enough, and not both rare and in the word list."""
    kept = freq.where((F.char_length("token") >= min_length) & F.col("token").rlike(r"^\p{L}+$"))
    if words is None:
        return kept
    known = words.select(F.col("word").alias("token"), F.lit(True).alias("known"))
    return kept.join(known, "token", "left").where(F.col("known").isNull() | (F.col("freq") > max_freq_err)).select("token", "freq")


def correction_map(
    freq: DataFrame, words: DataFrame | None = None, min_freq_std: int = 10, min_len_std: int = 3, max_freq_err: int = 3
) -> DataFrame:
    """(token, standard): each rare token with the most frequent standard one (ties by token) at distance one.

    The two most frequent tokens are never corrected.
    """
    index = clean_index(freq, words, min_len_std, max_freq_err)
    first_two = index.orderBy(F.col("freq").desc(), "token").limit(2).select("token")
    standard = index.where(F.col("freq") >= min_freq_std).select(F.col("token").alias("standard"), F.col("freq").alias("std_freq"))
    errors = index.where(F.col("freq") <= max_freq_err).select("token").join(F.broadcast(first_two), "token", "left_anti")
    left = standard.select("*", F.explode(shortened(F.lower("standard"))).alias("part"))
    right = errors.select("*", F.explode(shortened(F.lower("token"))).alias("part"))
    met = left.join(right, "part").select("token", "standard", "std_freq").distinct()
    distance = F.levenshtein(F.lower("standard"), F.lower("token"))
    near = met.where((distance == 1) | ((distance == 2) & adjacent_swap(F.col("standard"), F.col("token"))))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.col("std_freq").desc(), "standard"))
    return near.withColumn("rank", rank).where("rank = 1").select("token", "standard")


def apply_corrections(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """records with mapped tokens replaced, in place; every row by itself, whatever ids others have."""
    mapping = cut(mapping.select("token", "standard"))
    rows = held(mapping)
    if rows is not None:
        return records.select("ref_id", replaced(records, F.col("tokens"), {r["token"]: r["standard"] for r in rows}).alias("tokens"))
    return regrouped(placed_tokens(records).join(mapping, "token", "left"), F.coalesce("standard", "token"))
