"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import pathlib
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "signalmill", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where every task runs
    on this machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="signalmill-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_disposable = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written table."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_disposable, "open", ()):
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch_removed(spark: SparkSession):
    """Tables that this thread writes to scratch paths inside the block are removed at its end."""
    paths: list[str] = []
    stack = _disposable.__dict__.setdefault("open", [])
    stack.append(paths)
    try:
        yield
    finally:
        stack.remove(paths)
        for path in paths:
            remove(spark, path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reaches; nothing happens if there is none."""
    system, at = _file_system(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    system, at = _file_system(spark, path)
    if not system.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise RuntimeError(f"could not rename {path} to {to}")


def touch(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.create(at, True).close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    system, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where the driver runs it from a folder they don't have.

    Not needed where the package is installed on every node or given with ``--py-files``.
    """
    root = pathlib.Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)


def reliable(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so that lost executors do not recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
