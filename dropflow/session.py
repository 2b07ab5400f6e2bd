"""Spark session helpers.

The library never creates a session behind the caller's back inside an
operator; jobs receive a session. ``get_session`` is for tests, the bench
and command-line use. Cluster deployments pass their own session, whose
``spark.checkpoint.dir`` (a shared folder) is respected.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at any scale: AQE re-plans partition counts and splits
# skewed shuffle partitions at runtime; ANSI mode stays on (we use try_* forms).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "dropflow") -> SparkSession:
    """Return the active session or build a local one with sane settings."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    master = master or os.environ.get("DROPFLOW_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("DROPFLOW_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset.

    On a cluster this setting names a shared folder (HDFS/S3/...). A scratch
    folder of this machine is only chosen for a local master (tests, trials);
    elsewhere executors could not read it, so an unset folder is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not is_local(sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="dropflow-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_table(df: DataFrame, name: str, schema: str, partition_by: str | None = None) -> DataFrame:
    """Write a table under the shared checkpoint folder and read it back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers started on this machine import the package from where the driver did.

    Executors elsewhere get the package as any Spark job's code, with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def is_local(master: str) -> bool:
    """One JVM: ``local`` or ``local[..]`` (a local-cluster has executors with folders of their own)."""
    return master == "local" or master.startswith("local[")


def executor_cores(spark: SparkSession) -> int:
    """Cores that a job's only task finds on its executor (1 unless the session says how many there are)."""
    sc = spark.sparkContext
    return max(1, sc.defaultParallelism if is_local(sc.master) else int(sc.getConf().get("spark.executor.cores", "1")))


@contextmanager
def wide_tables(spark: SparkSession):
    """Turn the optimizer's constraint propagation off while a job plans and runs, then restore it.

    Census tables are wide (200 columns); inferred constraints over many aliased columns and IsNotNull
    filters grow exponentially in the optimizer.
    """
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield spark
    finally:
        spark.conf.set(key, before)


def for_wide_tables(job):
    """Decorator of jobs whose first argument is the session: run them inside :func:`wide_tables`."""
    @wraps(job)
    def run(spark, *args, **kwargs):
        with wide_tables(spark):
            return job(spark, *args, **kwargs)
    return run
