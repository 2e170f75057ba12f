"""Session construction and shared-storage helpers.

Everything here is ordinary Spark configuration.  On a cluster the
session is created by the platform; ``get_session`` only fills in the
settings this library relies on when they are not already present.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on.  AQE re-plans joins and shuffle sizes at
# run time and splits skewed sort-merge-join partitions; the session time
# zone is pinned so date/time functions agree with the DuckDB oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "wardstat",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, creating a local one if none exists.

    ``extra_conf`` carries deployment settings such as the object-store
    filesystem (``spark.hadoop.fs.s3a.impl``) without the library knowing
    about them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    platform (a shared filesystem every executor can reach).  Only when it
    is unset on a ``local[...]`` master (tests, laptops) is a fresh local
    folder made; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: configure a shared folder every "
                           "executor can reach (a machine-local folder would lose data)")
    own = tempfile.mkdtemp(prefix="wardstat-ckpt-")
    sc.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/wardstat/{name}-{uuid.uuid4().hex[:12]}"
