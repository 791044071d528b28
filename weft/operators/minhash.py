"""Recursive blocking by q-gram signatures, level by level.

A level extends every block that is deep and large enough by its rarest usable signatures, all blocks of a level in
parallel. A block is named by the path of signatures to it; numbers follow the order of paths.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import NORMALIZATION, gram_key, jaccard, pair_count, qgrams, record_tokens
from weft.operators.correct import correction_map, apply_corrections
from weft.operators.graph import dense_index
from weft.operators.tokens import term_frequency
from weft.session import cut
from weft.sources.files import read_words


@dataclass(frozen=True)
class BlockerConfig:
    """Everything that influences blocking. alpha and beta bound a signature's frequency inside a block."""

    id_column: str = "RecID"
    blocking_columns: tuple[str, ...] = ("Name", "Address")
    normalization_map: dict[str, str] = field(default_factory=lambda: dict(NORMALIZATION))
    q: int = 2
    auto_stopword_top_percentile: float = 0.005
    manual_stopwords: tuple[str, ...] = ()
    alpha: int = 2
    beta: int = 1000
    max_depth: int = 5
    min_block_size: int = 2
    max_keys_per_level: int = 3
    run_global_correction: bool = False
    gc_min_freq_std: int = 10
    gc_min_len_std: int = 3
    gc_max_freq_err: int = 3
    gc_word_list: str | None = None  # path of known words, which are not corrected while rare


def tokenize(df: DataFrame, config: BlockerConfig) -> DataFrame:
    """(ref_id, tokens). A missing column is an error before anything runs."""
    for name in (config.id_column, *config.blocking_columns):
        if name not in df.columns:
            raise KeyError(f"column {name!r} not found in {df.columns}")
    tokens = record_tokens(list(config.blocking_columns), config.normalization_map)
    return df.select(F.col(config.id_column).alias("ref_id"), tokens.alias("tokens"))


def token_keys(records: DataFrame, q: int) -> DataFrame:
    """(token, sig): one key per distinct token."""
    tokens = records.select(F.explode("tokens").alias("token")).distinct()
    return tokens.select("token", gram_key(qgrams("token", q)).alias("sig"))


def record_signatures(records: DataFrame, keys: DataFrame) -> DataFrame:
    """(ref_id, sig): distinct signatures of a record, without the empty one."""
    rows = records.select("ref_id", F.explode(F.array_distinct("tokens")).alias("token")).join(keys, "token")
    return rows.where(F.col("sig") != "MH_EMPTY").select("ref_id", "sig").distinct()


def signature_frequency(signatures: DataFrame) -> DataFrame:
    """(sig, freq): records per signature."""
    return signatures.groupBy("sig").agg(F.count(F.lit(1)).alias("freq"))


def stop_signatures(signatures: DataFrame, keys: DataFrame, top_share: float, manual: tuple[str, ...] = ()) -> DataFrame:
    """(sig): signatures of manual stop words, and the most frequent share of all (at least one), ties by signature."""
    named = keys.where(F.col("token").isin([word.lower() for word in manual])).select("sig")
    if top_share <= 0:
        return named.distinct()
    freq = signature_frequency(signatures)
    n = freq.count()
    cutoff = max(1, -int(-n * top_share // 1))
    # The share of all signatures may be large: ranks come from a distributed sort.
    frequent = dense_index(freq, [F.col("freq").desc(), F.col("sig")], "rank").where(F.col("rank") < cutoff).select("sig")
    return named.unionByName(frequent).distinct()


def signature_tree(signatures: DataFrame, stops: DataFrame, config: BlockerConfig) -> DataFrame:
    """(path, ref_id): members of every block below the root."""
    usable = cut(signatures.join(stops, "sig", "left_anti").select("ref_id", "sig"))
    frontier = cut(usable.select("ref_id").distinct().withColumn("path", F.array().cast("array<string>")))
    everyone = signatures.select("ref_id").distinct().count()
    levels: list[DataFrame] = []
    for depth in range(config.max_depth):
        if depth == 0:
            open_blocks = frontier if everyone > config.min_block_size else frontier.limit(0)
        else:
            sizes = frontier.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
            open_blocks = frontier.join(sizes.where(F.col("size") > config.min_block_size).select("path"), "path", "left_semi")
        inside = open_blocks.join(usable, "ref_id").where(~F.array_contains("path", F.col("sig")))
        counts = inside.groupBy("path", "sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(config.alpha, config.beta))
        rank = F.row_number().over(Window.partitionBy("path").orderBy("n", "sig"))
        chosen = counts.withColumn("rank", rank).where(F.col("rank") <= max(1, config.max_keys_per_level))
        large = chosen.where(F.col("n") >= max(2, config.min_block_size)).select("path", "sig")
        children = inside.join(large, ["path", "sig"]).select(F.array_append("path", F.col("sig")).alias("path"), "ref_id")
        frontier = cut(children)
        if frontier.isEmpty():
            break
        levels.append(frontier)
    if not levels:
        return frontier.select("path", "ref_id").limit(0)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("path", "ref_id")


def tree_blocks(members: DataFrame) -> DataFrame:
    """One row per block: block_id, depth, parent_block (null at depth 1), blocking_key, member_record_ids, size,
    used_keys_path. A row holds a block's members; beta bounds them."""
    grouped = members.groupBy("path").agg(F.array_sort(F.collect_list("ref_id")).alias("member_record_ids"))
    ids = cut(dense_index(grouped, [F.col("path")], "block_id").withColumn("block_id", F.col("block_id") + 1))
    up = ids.select(F.col("path").alias("above"), F.col("block_id").alias("parent_block"))
    joined = ids.withColumn("above", F.slice("path", F.lit(1), F.size("path") - 1)).join(up, "above", "left")
    return joined.select(
        "block_id", F.size("path").alias("depth"), "parent_block", F.element_at("path", -1).alias("blocking_key"), "member_record_ids",
        F.size("member_record_ids").alias("size"), F.array_sort("path").alias("used_keys_path"),
    )


def block_scores(members: DataFrame, records: DataFrame) -> DataFrame:
    """(path, a, b, score): Jaccard similarity of all pairs inside each block (B23, C12). A pair of records that meets in
    several blocks is compared once."""
    left, right = members.select("path", F.col("ref_id").alias("a")), members.select("path", F.col("ref_id").alias("b"))
    pairs = left.join(right, "path").where(F.col("a") < F.col("b"))
    sets = records.select("ref_id", F.array_distinct("tokens").alias("tokens"))
    unique = pairs.select("a", "b").distinct()
    scored = (
        unique.join(sets.select(F.col("ref_id").alias("a"), F.col("tokens").alias("ta")), "a")
        .join(sets.select(F.col("ref_id").alias("b"), F.col("tokens").alias("tb")), "b")
        .select("a", "b", jaccard(F.col("ta"), F.col("tb"), 1.0).alias("score"))
    )
    return pairs.join(scored, ["a", "b"]).select("path", "a", "b", "score")


class RecursiveMinHashBlocker:
    """The pipeline as an object: fit(df) computes, the rest are views. fit keeps no state from earlier calls."""

    def __init__(self, config: BlockerConfig = BlockerConfig()):
        self.config = config

    def fit(self, df: DataFrame) -> RecursiveMinHashBlocker:
        config = self.config
        records = tokenize(df, config)
        if config.run_global_correction:
            words = read_words(df.sparkSession, config.gc_word_list) if config.gc_word_list else None
            mapping = correction_map(term_frequency(records), words, config.gc_min_freq_std, config.gc_min_len_std, config.gc_max_freq_err)
            records = apply_corrections(records, mapping)
        self.source, self.records = df, cut(records)
        keys = cut(token_keys(self.records, config.q))
        self.signatures = cut(record_signatures(self.records, keys))
        self.stops = cut(stop_signatures(self.signatures, keys, config.auto_stopword_top_percentile, config.manual_stopwords))
        self.members = signature_tree(self.signatures, self.stops, config)
        return self

    def blocks(self) -> DataFrame:
        return tree_blocks(self.members)

    def scores(self) -> DataFrame:
        return block_scores(self.members, self.records)

    def export(self) -> DataFrame:
        """One row per block and member with the source's columns."""
        blocks = self.blocks().withColumn(self.config.id_column, F.explode("member_record_ids")).drop("member_record_ids")
        return blocks.join(self.source, self.config.id_column)

    def nested(self) -> DataFrame:
        """Blocks with their scored pairs nested."""
        blocks = self.blocks()
        listed = self.scores().groupBy(F.array_sort("path").alias("used_keys_path"), F.element_at("path", -1).alias("blocking_key")).agg(
            F.array_sort(F.collect_list(F.struct("a", "b", "score"))).alias("similarity_scores")
        )
        return blocks.join(listed, ["used_keys_path", "blocking_key"], "left")

    def metrics(self) -> DataFrame:
        return blocking_metrics(self.blocks(), self.records.count())


def blocking_metrics(blocks: DataFrame, total_records: int) -> DataFrame:
    """One row: counts, sizes, pairs with multiplicity, reduction ratio (may be negative), depth."""
    total = total_records * (total_records - 1) // 2
    pairs = F.coalesce(F.sum(pair_count("size")), F.lit(0))
    ratio: Column = 1.0 - pairs / total if total else F.lit(0.0)
    return blocks.agg(
        F.lit(total_records).cast("long").alias("total_records"), F.count(F.lit(1)).alias("num_blocks"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("avg_block_size"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest_block"),
        F.coalesce(F.min("size"), F.lit(0)).cast("long").alias("smallest_block"), ratio.alias("reduction_ratio"),
        pairs.alias("candidate_pairs"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth_reached"),
    )


def report(blocks: DataFrame) -> DataFrame:
    """(depth, size, n): the counts that a console report prints."""
    return blocks.groupBy("depth", "size").agg(F.count(F.lit(1)).alias("n"))


def print_report(blocks: DataFrame, shown: int = 20) -> None:
    """The console report: blocks by depth and size, most frequent first."""
    report(blocks).orderBy(F.col("n").desc(), "depth", "size").show(shown, truncate=False)


def demo(spark: SparkSession) -> DataFrame:
    """Seven records with three people in it."""
    rows = [
        (1, "John Smith", "12 Main Street"), (2, "Jon Smith", "12 Main St"), (3, "J Smith", "12 Main Street"), (4, "Mary Jones", "9 Oak Avenue"),
        (5, "Mary Jones", "9 Oak Ave"), (6, "Robert Lee", "55 Pine Road"), (7, "Bob Lee", "55 Pine Rd"),
    ]
    return spark.createDataFrame(rows, "RecID int, Name string, Address string")
