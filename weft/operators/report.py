"""Roll-ups of run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollups(runs: DataFrame, axes: list[str], value: str) -> DataFrame:
    """(axis, level, max, mean, median, n): one pass with grouping sets over every axis by itself."""
    known = runs.where(F.col(value).isNotNull()).select(*[F.col(a).cast("string").alias(a) for a in axes], F.col(value).alias("v"))
    grouped = known.groupingSets([[F.col(a)] for a in axes], *[F.col(a) for a in axes]).agg(
        *[F.grouping(a).alias(f"g_{a}") for a in axes], F.max("v").alias("max"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.count("v").alias("n")
    )
    axis: Column = F.lit(None).cast("string")
    level: Column = F.lit(None).cast("string")
    for a in axes:
        axis = F.when(F.col(f"g_{a}") == 0, a).otherwise(axis)
        level = F.when(F.col(f"g_{a}") == 0, F.col(a)).otherwise(level)
    return grouped.select(axis.alias("axis"), level.alias("level"), "max", "mean", "median", "n")


def correlation(runs: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    """One row (corr): Pearson correlation of two columns, null unless more than least rows have both."""
    both = runs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.when(F.count(F.lit(1)) > least, F.corr(x, y)).alias("corr"))


def dominance(runs: DataFrame, fp: str = "FP", fn: str = "FN", f1: str = "F1") -> DataFrame:
    """One row (fn_dominant, fp_dominant, zero_f1)."""
    return runs.agg(
        F.count_if(F.col(fn) > F.col(fp)).alias("fn_dominant"), F.count_if(F.col(fp) > F.col(fn)).alias("fp_dominant"), F.count_if(F.col(f1) == 0).alias("zero_f1")
    )


def extremes(runs: DataFrame, group: list[str], value: str, label: str) -> DataFrame:
    """(group..., best, best_value, worst, worst_value): argmax and argmin per group, ties by label."""
    known = runs.where(F.col(value).isNotNull())
    return known.groupBy(*group).agg(
        F.min_by(label, F.struct(-F.col(value), F.col(label))).alias("best"), F.max(value).alias("best_value"),
        F.min_by(label, F.struct(F.col(value), F.col(label))).alias("worst"), F.min(value).alias("worst_value"),
    )


def top(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order, with their rank: a top-k report."""
    first = df.orderBy(*by).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def markdown(rows: list[dict[str, object]]) -> str:
    """A table of collected report rows."""
    if not rows:
        return "(no rows)\n"
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join(number(row[name]) for name in names) + " |" for row in rows]
    return "\n".join(lines) + "\n"


def number(value: object, places: int = 4) -> str:
    """A report cell: dash for missing values, fixed places for floats."""
    if value is None or isinstance(value, float) and value != value:
        return "-"
    return f"{value:.{places}f}" if isinstance(value, float) else str(value)


def slug(text: str) -> str:
    """A file name of letters, digits, dots and dashes."""
    return "".join(c if c.isalnum() or c in "._-=" else "_" for c in text).strip("_")
