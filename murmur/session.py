"""Spark session defaults and the shared checkpoint folder.

Everything in the library works on a caller's session; ``get_spark`` is only
a convenience for tests, the bench and scripts.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on: wall-clock timestamps are compared in UTC,
# AQE re-plans joins (runtime broadcast, skew split, partition coalescing).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # target size of a post-shuffle partition; AQE coalesces or splits towards it
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "murmur", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode
    session without that setting (a quick trial) gets a folder of its own,
    which goes when the process ends; on a cluster a missing setting is an
    error, because a machine-local folder would not survive the loss of an
    executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="murmur-ckpt-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


# Folders of the runs that are open, innermost last (see ``run_scope``).
_open_runs: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables;
    inside a ``run_scope`` it lies in the run's folder."""
    base = _open_runs[-1] if _open_runs else checkpoint_dir(spark).rstrip("/") + "/tables"
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of written tables, wherever Spark keeps it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def run_scope(spark: SparkSession):
    """Tables that are cut inside the scope are dropped when it ends.  A result
    that outlives the scope is written with ``finish`` before."""
    path = scratch_path(spark, "run")
    _open_runs.append(path)
    try:
        yield path
    finally:
        _open_runs.remove(path)
        remove_path(spark, path)


@contextmanager
def settings(spark: SparkSession, conf: dict):
    """The session's settings ``conf`` inside the block, the former ones after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# the shuffle files of a written table go with the job that wrote it
_DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def finish(spark: SparkSession, job):
    """Run ``job()`` in a scope, write the DataFrame it returns, drop the run's
    own tables and return a read of the result."""
    out = scratch_path(spark, "result")
    with run_scope(spark):
        df = job()
        with settings(spark, _DROP_SHUFFLES):
            df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


# Writer options of tables whose words repeat: a dictionary a file holds each once.
REPEATS = {"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20), "parquet.block.size": str(32 << 20)}


def cut(df, **options):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    return a fresh read of it: lineage is cut and the plan runs exactly once
    (``Dataset.checkpoint`` without a cache would compute it twice).  Reads of
    the table get column pruning and filter pushdown; it survives the loss of
    any executor.  Never a local checkpoint.  ``options`` are the writer's."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    with settings(spark, _DROP_SHUFFLES):
        df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)
