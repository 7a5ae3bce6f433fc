"""Session construction and shared scratch locations."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fraudscope") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


# Settings we would start from on a ~1000-executor cluster reading ~100 TB of
# Parquet (passed to SparkSession.builder.config or spark-submit --conf).
# AQE sizes the shuffle from runtime statistics: start with many partitions
# and let it coalesce toward the advisory size; skewed partitions are split.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "512m",
    # the only broadcast left (period spine) is tiny; keep Spark's size check
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def cluster_session(app: str = "fraudscope", extra: dict[str, str] | None = None) -> SparkSession:
    """A session with ``CLUSTER_CONF`` (master and resources come from spark-submit)."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**CLUSTER_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session (or the context's checkpoint folder). Where neither
    is set, a local master gets a temporary folder; any other master raises,
    because each executor would write to its own disk. The context is pointed
    at the same folder, so ``DataFrame.checkpoint()`` writes there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect has no SparkContext
        sc = None
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set (master {master!r}): name a folder all executors share")
        root = tempfile.mkdtemp(prefix="fraudscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the checkpoint root; Spark's writers create it."""
    return f"{checkpoint_root(spark)}/fraudscope/{name}-{uuid.uuid4().hex}"
