"""Session factory and the one place that decides where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "embermill", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow).

    On a cluster, pass your own session instead; no operator sets a session option."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("EMBERMILL_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EMBERMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local (tests,
    a laptop). A cluster's executors share no temporary folder, so there the setting is required."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="embermill-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that several later jobs read. It lies in the shared checkpoint folder, so it
    outlives any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share(spark: SparkSession, thing: object):
    """Broadcast anything, of classes of this package too; gives the function by which a task reads it."""
    import pickle

    from pyspark import cloudpickle

    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)
