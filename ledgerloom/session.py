"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Run-time settings: they can be set on a session somebody else built.
RUNTIME_SETTINGS = {
    # one hot key may hold a third of the rows: let AQE split its partition even
    # where that costs one more exchange downstream
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # dates must not depend on where the driver runs
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session.

    Broadcast thresholds and partition counts are left to the cluster. Joins with
    dimensions that grow with the data carry no hint: Catalyst broadcasts them only
    when their measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "ledgerloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that tasks hand to Python, unless the session has a bound."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(8 << 20))


def kept(df: DataFrame) -> DataFrame:
    """A frame that is expensive to make and read more than once.

    It is written to ``spark.checkpoint.dir`` where the session names one, and else kept on the
    disks of the executors, which make lost parts again.
    """
    once = computed_once(df)
    return df.persist(StorageLevel.DISK_ONLY) if once is df else once


def computed_once(df: DataFrame) -> DataFrame:
    """A frame that several branches of a plan read, computed once where the cluster allows.

    Spark reuses an exchange only when both branches plan it alike, and a join's inferred
    ``IS NOT NULL`` filter is enough to make them differ; the fact would then be read twice.
    Where the session names ``spark.checkpoint.dir`` (shared storage, so a lost executor loses
    nothing) the frame is written there; use it on aggregated frames. Elsewhere, as in local
    tests, the frame stays lazy.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()
