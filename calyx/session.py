"""Spark session and checkpoint-directory handling.

On a cluster the session is created by the platform and `spark.checkpoint.dir`
points at shared storage; we only read it.  Tests and local runs get a fresh
scratch folder when the setting is absent.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Conf applied only when the session is created here (tests, bench, CLI).
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.ansi.enabled": "false",
}


def get_spark(master: str = "local[8]", app: str = "calyx", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, creating a scratch one only when unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="calyx-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session: the server owns the folder
        return conf_dir
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
