"""Session settings shared by tests, bench and the driver entry.

On a cluster the session already exists; ``tune`` only sets what is unset
and never overrides the cluster's own ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so DATE(ts) and month keys agree with the
# oracle, AQE for runtime re-planning (coalescing, skew splitting, runtime
# broadcast conversion based on measured shuffle sizes).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small but CPU-heavy shuffles (exploded probes, fan-out joins) keep
    # their parallelism; at cluster scale partitions are far above this.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Static broadcast only below 10 MB of *estimated* size; AQE re-checks
    # with real shuffle statistics before converting a join at runtime.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a repeated key in a request body the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "innlytics", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above.

    ``master`` is only applied when given, so on a cluster the launcher's
    master wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply runtime SQL defaults to an existing session where unset. The
    session's time zone is its owner's; stored times are without zone."""
    for key, value in DEFAULT_CONF.items():
        if key.startswith("spark.ui"):
            continue
        try:
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        except Exception:  # static conf on a running session
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared (HDFS/object store) folder and is
    used as is; without it a cluster session is refused, because executors do
    not see each other's disks. Only a local session (one machine, as in
    tests) gets a scratch folder when it is unset.
    """
    sc = _context(spark)
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="innlytics-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - core conf not settable at runtime
            pass
    if sc is None:
        return current
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None


def session_key(spark: SparkSession) -> int:
    """Stable identity of a session (classic or Spark Connect)."""
    return id(getattr(spark, "_jsparkSession", None) or spark)
