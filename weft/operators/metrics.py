"""Pair-based evaluation and size statistics of clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import pair_count


def cluster_pairs(members: DataFrame, by: str) -> DataFrame:
    """(a, b), a < b: pairs of records of one group."""
    left = members.select(by, F.col("ref_id").alias("a"))
    right = members.select(by, F.col("ref_id").alias("b"))
    return left.join(right, by).where(F.col("a") < F.col("b")).select("a", "b")


def within(truth: DataFrame, universe: DataFrame) -> DataFrame:
    """truth rows whose record is part of the input."""
    return truth.join(universe.select("ref_id").distinct(), "ref_id", "left_semi")


def _scores(tp: Column, linked: Column, expected: Column) -> list[Column]:
    precision = F.when(linked > 0, tp / linked).otherwise(1.0)
    recall = F.when(expected > 0, tp / expected).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [
        tp.alias("TP"), expected.alias("E"), linked.alias("L"), (linked - tp).alias("FP"), (expected - tp).alias("FN"),
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
    ]


def pair_metrics(candidates: DataFrame, truth: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row TP, E, L, FP, FN, precision, recall, f1 from distinct candidate pairs (a, b) and truth(ref_id, truth_id).

    True pairs are counted by arithmetic and hits by looking up both ends, so no true pair is ever formed.
    """
    truth = within(truth, universe) if universe is not None else truth
    expected = truth.groupBy("truth_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(pair_count("n")), F.lit(0)).alias("e"))
    ta = truth.select(F.col("ref_id").alias("a"), F.col("truth_id").alias("x"))
    tb = truth.select(F.col("ref_id").alias("b"), F.col("truth_id").alias("y"))
    found = candidates.join(ta, "a", "left").join(tb, "b", "left").agg(
        F.count(F.lit(1)).alias("l"), F.coalesce(F.count_if(F.col("x") == F.col("y")), F.lit(0)).alias("tp")
    )
    return found.crossJoin(expected).select(*_scores(F.col("tp"), F.col("l"), F.col("e")))  # one row each


def cluster_metrics(clusters: DataFrame, truth: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """pair_metrics of disjoint clusters(ref_id, cluster_id), from counts per cluster, class and both: no pairs at all."""
    truth = within(truth, universe) if universe is not None else truth
    joined = clusters.join(truth, "ref_id", "full")
    cells = joined.groupBy("cluster_id", "truth_id").agg(F.count(F.lit(1)).alias("n"))

    def pairs(groups: DataFrame, name: str) -> DataFrame:
        return groups.agg(F.coalesce(F.sum(pair_count("n")), F.lit(0)).alias(name))

    tp = pairs(cells.where(F.col("cluster_id").isNotNull() & F.col("truth_id").isNotNull()), "tp")
    linked = pairs(cells.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.sum("n").alias("n")), "l")
    expected = pairs(cells.where(F.col("truth_id").isNotNull()).groupBy("truth_id").agg(F.sum("n").alias("n")), "e")
    return tp.crossJoin(linked).crossJoin(expected).select(*_scores(F.col("tp"), F.col("l"), F.col("e")))  # one row each


def size_distribution(members: DataFrame, by: str) -> DataFrame:
    """(size, n): groups by size."""
    return members.groupBy(by).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def size_l1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (size_distribution_l1, cluster_count_diff): how far two size distributions are apart."""
    a = predicted.select("size", F.col("n").alias("p"))
    b = truth.select("size", F.col("n").alias("t"))
    p, t = F.coalesce("p", F.lit(0)), F.coalesce("t", F.lit(0))
    return a.join(b, "size", "full").agg(
        F.coalesce(F.sum(F.abs(p - t)), F.lit(0)).alias("size_distribution_l1"), F.coalesce(F.sum(p - t), F.lit(0)).alias("cluster_count_diff")
    )


def size_summary(members: DataFrame, by: str) -> DataFrame:
    """One row: n_total, n_multi, n_singletons, min, max, mean (3 places) and median size. From counts per size."""
    sizes = size_distribution(members, by)
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("n"))), F.lit(0)).alias("n_multi"),
        F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0)).alias("n_singletons"),
        F.coalesce(F.min("size"), F.lit(0)).alias("min_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
        F.coalesce(F.round(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 3), F.lit(0.0)).alias("mean_size"),
        F.coalesce(F.percentile("size", F.lit(0.5), F.col("n")), F.lit(0.0)).alias("median_size"),
    )


def reduction(pairs: DataFrame, n_records: int) -> DataFrame:
    """One row (n_pairs, brute_force, reduction_pct)."""
    brute = n_records * (n_records - 1) // 2
    saved: Column = F.round(100 * (1 - F.count(F.lit(1)) / brute), 4) if brute else F.lit(0.0)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.lit(brute).cast("long").alias("brute_force"), saved.alias("reduction_pct"))


def run_metrics(clusters: DataFrame, truth: DataFrame | None = None, config: dict | None = None, timings: dict[str, float] | None = None) -> DataFrame:
    """One row of nested run metrics: config, record counts, predicted and true sizes, pair metrics, distances, timings."""
    def distribution(sizes: DataFrame) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("size", "n"))), lambda s: F.struct(s["size"].cast("string"), s["n"]))
        return sizes.agg(F.map_from_entries(ordered).alias("size_distribution"))

    def nested(members: DataFrame, by: str, name: str) -> DataFrame:
        both = size_summary(members, by).crossJoin(distribution(size_distribution(members, by)))  # one row each
        return both.select(F.struct("*").alias(name))

    out = clusters.agg(F.count(F.lit(1)).alias("n_records_total"), F.count_distinct("ref_id").alias("n_unique_records"))
    out = out.crossJoin(nested(clusters, "cluster_id", "predicted_clusters"))
    if config:
        out = out.withColumn("config", F.struct(*[F.lit(v).alias(k) for k, v in config.items()]))
    if truth is not None:
        known = within(truth, clusters)
        out = out.crossJoin(nested(known, "truth_id", "truth_clusters"))
        out = out.crossJoin(cluster_metrics(clusters, known).select(F.struct("*").alias("pair_metrics")))
        out = out.crossJoin(size_l1(size_distribution(clusters, "cluster_id"), size_distribution(known, "truth_id")))
    if timings:
        out = out.withColumn("timings_seconds", F.struct(*[F.lit(round(v, 3)).alias(k) for k, v in timings.items()]))
    return out
