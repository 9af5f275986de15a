"""Session settings for the jobs in this package."""

from __future__ import annotations

import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "wiretide",
                  memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use ``configure`` on the given session."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: every operator works on UTC microseconds."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a local one only where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="wiretide-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


_REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _sweeping = threading.Lock(), WeakKeyDictionary()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go when its execution ends, not when the driver happens to collect garbage.

    For executions whose result is written or counted; the setting of the session holds again afterwards.
    """
    with _lock:
        state = _sweeping.setdefault(spark, {"open": 0})
        if not state["open"]:
            state["before"] = spark.conf.get(_REMOVAL, None)
            spark.conf.set(_REMOVAL, "true")
        state["open"] += 1
    try:
        yield
    finally:
        with _lock:
            state["open"] -= 1
            if not state["open"]:
                spark.conf.unset(_REMOVAL) if state["before"] is None else spark.conf.set(_REMOVAL, state["before"])
