"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# Every value here is a default for runs that build their own session; a cluster's
# own settings win because ``getOrCreate`` keeps an existing session.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("inkprobe")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folder: str | None = None
_staged: list[str] = []

# Spark removes shuffle files when the driver's JVM happens to collect garbage, which may be after all input has gone through several shuffles;
# with this setting, at the end of the write.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: WeakKeyDictionary[SparkSession, tuple[int, str | None]] = WeakKeyDictionary()
_lock = Lock()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed within are removed as it ends; for plans that are executed once. Threads may overlap."""
    with _lock:
        n, before = _writing.get(spark, (0, None))
        before = before if n else spark.conf.get(_CLEANUP, None)
        _writing[spark] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing[spark]
            _writing[spark] = n - 1, before
            if n == 1:
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder of
    this process stands in, but only for a local master: executors elsewhere could not see it, so
    any other master raises.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"master {master!r} needs a folder that all executors share in spark.checkpoint.dir")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="inkprobe-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the staging folder, which ``discard_staged`` removes."""
    path = f"{staging_root(spark)}/inkprobe/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared staging folder and read it back.

    The result survives lost executors, is computed exactly once however often it is
    used, and carries real file sizes, so the planner picks join strategies from facts.
    The files stay until ``discard`` or ``discard_staged``; those of its shuffles go at once.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def stage_counting(df: DataFrame, name: str, what: Column) -> tuple[DataFrame, int]:
    """``df`` staged, and the number of its rows for which ``what`` holds, counted while they are written."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count_if(what).alias("n")), name)
    return staged, seen.get["n"]


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` returned and that nothing will read again."""
    for df in staged:
        path = vars(df)["staged_at"]
        _delete(df.sparkSession, path)
        if path in _staged:
            _staged.remove(path)


def discard_staged(spark: SparkSession) -> int:
    """Delete every table that this process has staged; call it once the results are written.

    Returns how many folders went. Frames that read them are dead afterwards.
    """
    gone = 0
    while _staged:
        gone += _delete(spark, _staged.pop())
    return gone
