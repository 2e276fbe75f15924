"""Session helpers: configuration a segmentation job wants, nothing more."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library relies on. They are runtime SQL confs,
# so they can be applied to an existing (cluster) session as well.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tiercraft") -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the session
    the platform hands you and call :func:`configure` on it."""
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g"))
    for k, v in SQL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_CONF.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, as the cluster names it in
    ``spark.checkpoint.dir``. Only a single-process session (``local[...]``,
    as in tests) gets a temporary folder when none is set; anywhere else a
    machine-local folder would be lost to the other executors, so it raises."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tiercraft-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
