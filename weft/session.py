"""Session helpers: table readers and lineage cuts in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, Row, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; only Spark opens the path, so any store that Spark knows will do.

    A table of far fewer files than cores is dealt out to them: one task may read each file, but many share the work on its rows.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * len(df.inputFiles()) <= cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: keep what is set, else use spark.checkpoint.dir.

    Where neither is set, a local master gets a temporary folder (tests, notebooks). On a cluster that
    would be a folder other machines cannot see, so there it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "weft-checkpoints"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Inside, the settings have these values."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, queries that are made and run leave no shuffle files.

    Else these stay until the driver happens to collect its garbage, and the rounds of a loop pile up: every shuffle has three small
    files for each task that writes, however few the rows.
    """
    return _set(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def one_row(df: DataFrame) -> Row:
    """The row of a global aggregate of stored rows.

    Its plan has nothing to adapt, so it is not adaptive: an adaptive one costs the driver a thread that idles for a minute and copies
    of the plan for its history, which loops multiply.
    """
    spark = df.sparkSession
    with tidy(spark), _set(spark, {"spark.sql.adaptive.enabled": "false"}):
        return df.first()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and continue from its reliable checkpoint, so that lost executors cost no recomputation and shuffle files go."""
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # made anew: a query takes that setting when it is made


@contextmanager
def measured(spark: SparkSession) -> Iterator[None]:
    """Inside, a join that runs broadcasts a side only if that has been measured at run time to be as small as Spark's threshold asks.

    What is planned from files alone is an estimate: compressed files, exploded lists and checkpoints made of either are larger by far.
    """
    planned, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    with _set(spark, {adaptive: spark.conf.get(adaptive, None) or spark.conf.get(planned), planned: "-1"}):
        yield


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that cut() returned, once what was made of it is checkpointed itself or no longer needed.

    Loops call it, so that their folders hold a few rounds, not all of them. Anything else stays until the folder is removed.
    """
    context = df.sparkSession.sparkContext
    try:
        kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    except Exception:  # no plain checkpoint: nothing to delete
        return
    if kept.isDefined():
        path = context._jvm.org.apache.hadoop.fs.Path(kept.get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
