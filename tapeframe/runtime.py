"""Session settings and the one way this package materialises an intermediate table.

``stage`` writes a frame as Parquet under the shared folder named by
``spark.checkpoint.dir`` and reads it back.  It cuts lineage in a way that
survives lost executors, keeps column pruning, and gives Spark real file sizes,
so whether a staged side is broadcast is decided by Spark's own size threshold.
No operator in this package forces a broadcast.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_own_folders: list[tuple[SparkSession, str]] = []


def build_session(master: str = "local[8]", app: str = "tapeframe", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's own, or a private one in local tests."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return _own_folder(spark, configured.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="tapeframe-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def _own_folder(spark: SparkSession, configured: str) -> str:
    """A folder of this process in the shared one, removed when the process ends in order."""
    for session, path in _own_folders:
        if path.startswith(f"{configured}/") and session.sparkContext is spark.sparkContext:
            return path
    path = f"{configured}/tapeframe-{uuid.uuid4().hex}"
    _own_folders.append((spark, path))
    if len(_own_folders) == 1:
        atexit.register(_remove_own_folders)
    return path


def _remove_own_folders() -> None:
    for spark, path in _own_folders:
        if spark.sparkContext._jsc is None:  # stopped: nothing can be reached any more
            continue
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write once, read many times; see the module text."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        frame.write.parquet(path, compression="zstd")
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes in here, and of frames made and collected in here, go when they end.

    Else they stay until the driver happens to collect its garbage, and the disk holds those of every step at once.
    Every write is planned anew, so nothing needs them later.  A write takes the setting when it starts, a frame that is
    collected takes it when it is made.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
