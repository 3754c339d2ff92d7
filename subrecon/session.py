"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "subrecon",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local-mode session for tests, the bench and small runs."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it to shared storage and it is used as
    is; if it is missing there, this fails rather than fall back to a
    machine-local folder. Only in local mode (tests, the bench) is a fresh
    scratch folder created and registered when it is unset.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder for this job")
        d = tempfile.mkdtemp(prefix="subrecon-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


DEFAULT_SHUFFLE_PARTITIONS = "200"  # Spark's own default


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size on storage of the given paths (driver-side metadata only); a missing one fails."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return total


def size_shuffle(spark: SparkSession, total_bytes: int, target_bytes: int = 256 << 20) -> int | None:
    """Start AQE from enough shuffle partitions for ``total_bytes`` of input.

    AQE only coalesces small partitions; it never splits an oversized one
    outside skew joins, so the initial count must fit the largest shuffle.
    Applied only when the deployment set neither the initial AQE count nor
    ``spark.sql.shuffle.partitions``; returns the count set, else None.
    """
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(key, None):
        return None
    if spark.conf.get("spark.sql.shuffle.partitions", DEFAULT_SHUFFLE_PARTITIONS) != DEFAULT_SHUFFLE_PARTITIONS:
        return None
    n = -(-total_bytes // target_bytes)
    n = max(spark.sparkContext.defaultParallelism, n)
    spark.conf.set(key, str(n))
    return n


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this run wrote, in whichever file system it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


SKEW_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # ``reconciled`` chains two joins on the same keys; splitting a hot
    # partition of the first would break the second's partitioning, and
    # AQE declines that unless it may add the needed shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare_for_skew(spark: SparkSession) -> dict[str, str]:
    """Turn on AQE skew-join splitting where the deployment left it unset.

    Returns the settings it changed. Explicit settings are kept.
    """
    changed = {}
    jconf = spark._jsparkSession.conf()
    for k, v in SKEW_DEFAULTS.items():
        if not jconf.contains(k):
            spark.conf.set(k, v)
            changed[k] = v
    return changed
