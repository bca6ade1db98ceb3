"""Session helpers: settings the library expects, and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app_name: str = "assayframe", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session carrying the settings in :data:`DEFAULT_CONF`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the durable checkpoint folder, setting one only where none is named.

    A cluster names a shared folder in ``spark.checkpoint.dir``. A temporary
    folder is acceptable in local mode only, where driver and executors share
    one machine; anywhere else a missing setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(configured)
    return configured


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage into the checkpoint folder.

    Used where two passes must see the very same partition layout (rank
    offsets, task positions): recomputing after an executor loss could otherwise
    lay rows out differently between the passes.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
