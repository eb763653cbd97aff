"""Session set-up and the one rule for cutting lineage: reliable checkpoints in a shared folder."""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "granary", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC time; a cluster's own settings win where they are set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    spark.checkpoint.dir where the cluster names it; a temporary folder only where it is unset and
    the master is local, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="granary-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Inside, Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.

    What is run inside should be kept, as a checkpoint or a table: run again, it would be computed again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation of its past; its shuffle files are freed."""
    shared_dir(df.sparkSession)
    with freed(df.sparkSession):
        return df.filter("true").checkpoint(eager=True)  # a new query: the setting holds for those made under it


def cores(spark: SparkSession) -> int:
    """Tasks that run at once, as far as Spark knows."""
    return spark.sparkContext.defaultParallelism


def retried(step, times: int = 5, within: float = 120.0):
    """step() again after a failed job, `times` times at most in any `within` seconds; then the failure goes up.

    Steps read checkpointed state, so that a repeated one does the same again.
    """
    import time

    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    failed: list[float] = []
    while True:
        try:
            return step()
        except (PySparkException, Py4JError):
            now = time.monotonic()
            failed = [t for t in failed if now - t < within] + [now]
            if len(failed) >= times:
                raise
