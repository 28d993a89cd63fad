"""Session set-up: the settings the engine assumes, and making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew-join splitting; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return ensure_importable(builder.config(map=settings).getOrCreate())


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Put this package's folder on the Python workers' path (on a cluster without it there, use --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``); a temporary one, the same for the
    whole process, only where none is set and all run in one process."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
    return _local[0]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; false if ``target`` is there already."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not files.exists(path(target)) and files.rename(path(source), path(target))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """A table that is read in fewer splits than there are cores, dealt out to all of them before heavy work on its rows;
    a larger one stays as it lies.  ``scan`` reads files and shuffles nothing."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


_changed: dict[str, list] = {}
_lock = threading.Lock()


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Meanwhile a setting has another value; threads that want the same may do so at once."""
    with _lock:
        _changed.setdefault(key, [])
        if not _changed[key]:
            before = spark.conf.get(key, None)
            spark.conf.set(key, value)
        else:
            before = _changed[key][0]
        _changed[key].append(before)
    try:
        yield
    finally:
        with _lock:
            before = _changed[key].pop()
            if not _changed[key]:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def splits(spark: SparkSession, size: int):
    """Meanwhile files are read in splits of some ``size`` bytes at most; threads that want the same size may do so at once."""
    return _set(spark, "spark.sql.files.maxPartitionBytes", str(size))


def freed_shuffles(spark: SparkSession):
    """Meanwhile a query's shuffle files go when it ends, not when the driver collects its garbage; for queries that keep
    nothing by ``persist``."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Run jobs side by side; an error of one is raised when all have ended."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        running = [pool.submit(inherit(job)) for job in jobs]
    for job in running:
        job.result()


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read_bytes(spark: SparkSession, path: str) -> bytes:
    files, target = file_system(spark, path)
    stream = files.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time (milliseconds) of each entry of a folder; none if it is not there."""
    files, target = file_system(spark, folder)
    if not files.exists(target):
        return []
    return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(target)]


def remove(spark: SparkSession, path: str) -> None:
    files, target = file_system(spark, path)
    files.delete(target, True)


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a file that is not there yet, all of it or nothing; false if another one was first.

    The bytes go to a file beside it, which then takes the name: by a hard link on local disks, and else by a rename,
    which must refuse an existing target (as HDFS does).
    """
    files, target = file_system(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.new"
    files, new = file_system(spark, beside)
    stream = files.create(new, True)
    stream.write(bytearray(data))
    stream.close()
    try:
        if target.toUri().getScheme() in (None, "file"):
            try:
                os.link(new.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not files.exists(target) and files.rename(new, target)
    finally:
        files.delete(new, False)


def folder_sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """The bytes of all files below each sub-folder."""
    files, target = file_system(spark, folder)
    found, root = files.listFiles(target, True), files.makeQualified(target).toUri().getPath() + "/"
    sizes: dict[str, int] = {}
    while found.hasNext():
        status = found.next()
        inner = status.getPath().toUri().getPath().removeprefix(root).split("/")
        if len(inner) > 1:
            sizes[inner[0]] = sizes.get(inner[0], 0) + status.getLen()
    return sizes
