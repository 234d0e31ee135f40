"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint folder, broadcast
threshold) are read from the session when a cluster already set them;
the defaults below only fill gaps, as in tests and local benches.
"""

from __future__ import annotations

import os
import shlex
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Defaults applied only when the session does not already define them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce small post-shuffle partitions to the advisory size rather than
    # keeping many tiny tasks (the setting Spark recommends for busy clusters)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's join partition even when that costs an extra shuffle:
    # with a third of all rows on one key, one task would otherwise do it all
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Spark's own size check for broadcast joins (plan statistics, and
    # AQE re-checks with the real shuffle sizes). Above it: sort-merge.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def _submitted() -> set[str]:
    """Settings that the submit command gives (spark-submit, or its arguments in the environment)."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # spark-submit has started the JVM: it knows
        SparkContext._ensure_initialized()
        return {k for k, _ in SparkConf().getAll()}
    args = shlex.split(os.environ.get("PYSPARK_SUBMIT_ARGS", ""))
    names = {"--master": "spark.master", "--driver-memory": "spark.driver.memory", "--name": "spark.app.name"}
    given = {names[a.split("=")[0]] for a in args if a.split("=")[0] in names}
    for a, value in zip(args, args[1:] + [""]):
        if a in ("--conf", "-c"):
            given.add(value.split("=")[0])
        elif a.startswith("--conf="):
            given.add(a.split("=")[1])
    return given


def get_spark(master: str | None = None, app: str = "wardbook",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one. What the deployment sets (by
    spark-submit or spark-defaults) is left as it is; only gaps are filled, and
    only a local session gets settings for its single machine."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_defaults(active)
        return active
    given = _submitted()
    b = SparkSession.builder
    local = (master or "").startswith("local")
    start = {"spark.app.name": app, **({"spark.master": master} if master else {}),
             **({"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                 "spark.driver.memory": os.environ.get("WARDBOOK_DRIVER_MEM", "16g")} if local else {})}
    for k, v in start.items():
        if k not in given:
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known = spark.sparkContext.getConf()
    partitions = shuffle_partitions or (8 if local else None)
    for k, v in {**_DEFAULTS, "spark.sql.execution.arrow.pyspark.enabled": "true",
                 **({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})}.items():
        if not known.contains(k):
            spark.conf.set(k, v)
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_root(spark)


_LOCAL_ROOTS: dict[str, str] = {}  # local-mode fallback folder per application


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read as is. Only
    when it is unset (local tests) a scratch folder is created.
    """
    sc = spark.sparkContext
    d = (spark.conf.get("spark.checkpoint.dir", None)
         or sc.getConf().get("spark.checkpoint.dir", None)
         or _LOCAL_ROOTS.get(sc.applicationId))
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="wardbook-ckpt-")
        _LOCAL_ROOTS[sc.applicationId] = d
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - a core setting may be read-only at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never machine-local)."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Write ``df`` once as a Parquet table under the shared checkpoint folder
    and return it re-read: the lineage is cut (an executor lost later does not
    recompute the plan), and the re-read is a columnar scan with pruning and
    statistics."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
