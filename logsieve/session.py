"""Session set-up and where cut lineage is written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "logsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings win over ours."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
        if configured is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="logsieve-ckpt-"))
    return str(context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; a local folder only where none is set."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
