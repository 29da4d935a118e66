"""Session set-up and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ionloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans count on; on a cluster, leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` (shared by all executors); a local one only where it is unset, as in tests."""
    sc = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not wanted:
        wanted = os.path.join(tempfile.gettempdir(), "ionloom-checkpoints")
    sc.setCheckpointDir(wanted)
    return wanted


#: The applications whose tables are removed when they end.
_removed_at_exit: set[str] = set()


def drop_cuts(spark: SparkSession) -> None:
    """Remove what :func:`cut` wrote in this application; DataFrames that read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark) + "/cuts")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_quietly(spark: SparkSession) -> None:
    try:
        drop_cuts(spark)
    except Exception:  # the JVM has gone already
        pass


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, removed when the application ends."""
    folder = checkpoint_dir(spark)
    if folder not in _removed_at_exit:
        _removed_at_exit.add(folder)
        atexit.register(_drop_quietly, spark)
    return f"{folder}/cuts/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the checkpoint folder and read again: cuts its lineage and survives the loss of any executor.

    ``checkpoint()`` would compute the last stage twice, once to count and once to write. The tables are removed when
    the application ends, or by :func:`drop_cuts`.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_place(df: DataFrame) -> DataFrame:
    """``df`` checkpointed with its partitioning and order, so that later groupings by its keys need no exchange.

    They are kept only if the plan was made without adaptive execution.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
