"""Session, table and shared-folder helpers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The only setting in which the cluster names a folder that all executors share.
CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("stratacel")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    The cluster's ``spark.checkpoint.dir`` is used as it stands. Only where it is unset, as in
    tests, a local temporary folder is made and set, so that later calls agree.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="stratacel-")
        spark.conf.set(CHECKPOINT_CONF, named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the data is written to the shared folder and the lineage is cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a columnar, compressed checkpoint."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """A number of partitions or buckets that follows the size of the input."""
    least = shuffle_partitions(df.sparkSession)
    return max(least, math.ceil(estimated_bytes(df) / bytes_each))


def spread(df: DataFrame) -> DataFrame:
    """Give Python work all cores where the scan has fewer splits than there are cores.

    A large input has more splits than that and is passed through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
