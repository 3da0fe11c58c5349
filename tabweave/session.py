"""Session settings, shared scratch space and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tabweave", cores: int | str = "*", **conf: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster spark-submit sets these."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory every executor can reach.

    It lives under ``spark.checkpoint.dir``. Only a local master without that
    setting gets a machine-local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tabweave/{label}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix=f"tabweave-{label}-") + "/data"
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to reliable storage so lost executors do not matter.

    ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes the files again
    when the result is no longer referenced.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate of ``df`` is below its broadcast threshold."""
    limit = int(str(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 <= size <= limit
