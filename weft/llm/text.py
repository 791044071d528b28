"""Shared column helpers for operators that read whole texts."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text in one Arrow batch. Larger batches gain nothing, but both the JVM and a worker hold several.
BATCH_BYTES = 8 << 20


def bound_batches() -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES, unless it is lower already."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    now = spark.conf.get(BATCH_SETTING)
    size = int(now[:-1]) if now.endswith("b") and now[:-1].lstrip("-").isdigit() else None
    if size is not None and size > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def utf8(column: str | Column) -> Column:
    """The text's bytes, null as empty: Arrow then hands over buffers without decoding them."""
    bound_batches()
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")
