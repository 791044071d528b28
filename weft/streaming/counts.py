"""Token frequencies and new blocking keys of a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions.text import compress_tokens


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def token_counts(stream: DataFrame, text_col: str) -> DataFrame:
    """(token, freq): running frequencies; the state has one row per distinct token."""
    return stream.select(F.explode(compress_tokens(text_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def windowed_counts(stream: DataFrame, text_col: str, time_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, token, freq): frequencies per time window; a watermark lets finished windows go."""
    tokens = stream.withWatermark(time_col, late).select(time_col, F.explode(compress_tokens(text_col)).alias("token"))
    counted = tokens.groupBy(F.window(time_col, window).alias("w"), "token").agg(F.count(F.lit(1)).alias("freq"))
    return counted.select(F.col("w.start").alias("start"), "token", "freq")


def to_memory(counts: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Start a query into an in-memory table: for tests and consoles."""
    return counts.writeStream.format("memory").queryName(name).outputMode(mode).start()


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of updates as a Parquet folder of its batch number, so that a repeated batch replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).start()
