"""Session helpers: checkpoints in the cluster's shared folder, and a local session for tests."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder of this process for local runs, removed at its end."""
    folder = tempfile.mkdtemp(prefix="cutloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` of the session names; where it is unset, one of our own on a local master.

    RuntimeError on any other master: a folder of one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_folder()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Have checkpoints in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder for a written table, in the shared folder; it is deleted when this process ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def _drop_quietly(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have ended before
        drop_folder(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: for what is read more than once, with other columns or filters each time."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """A broadcast hint if a count proves that df has at most ``limit`` rows, else df as it is (a shuffle join).

    df should be cheap to count: checkpointed, or small by construction.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame, least: int = 16) -> DataFrame:
    """df over enough tasks for work in Python: inputs of a few splits (less than ``least``, and than the cores) are redistributed, larger ones stay in place."""
    tasks = min(least, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def settled(df: DataFrame) -> DataFrame:
    """A few rows (the k hits of a search), computed once and kept as a local relation."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def local_session(cpus: int | str = "*", name: str = "cutloom", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": _own_folder(),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
