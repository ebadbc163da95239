"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins and partition counts at run
# time from real shuffle statistics; the skew-join split handles hot join keys.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# What a Python worker gets at a time in ``small_batches``.
INPUT_BYTES = 4 << 20

# Static settings applied only when this package builds the session: Spark removes
# checkpoint files of RDDs that are no longer referenced.
BUILD_ONLY = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shopfloor") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **BUILD_ONLY}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (the driver's)."""
    for key, value in SESSION_DEFAULTS.items():
        if not key.startswith("spark.ui"):  # static: only a session builder may set it
            spark.conf.set(key, value)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime SQL setting for the jobs run inside; the session's own value comes back after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession):
    """For jobs whose Python workers read texts: record batches of some MB, whatever the length of a row
    (Spark's own limit is 10,000 rows)."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(INPUT_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine session (``local[..]``) may leave the setting out; it then gets
    a folder of its own. On a cluster a machine-local folder would be written by every
    executor on its own disk, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all "
                               "executors share")
        base = os.path.join(tempfile.gettempdir(), "shopfloor-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def checkpoint_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the
    lineage, survives lost executors and gives later joins real size statistics."""
    path = checkpoint_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
