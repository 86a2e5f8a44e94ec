"""Session helpers: building a session and cutting lineage in shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dir: str | None = None


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "prismarium") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where it is unset and everything runs in this process, as in local tests, a temporary folder of this machine is used.
    On a cluster that would lose rows silently, so there the setting is required.
    """
    global _own_dir
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="prismarium-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def _own_scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/prismarium-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that read them must have been written before."""
    delete(spark, _own_scratch(spark))


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        clear_scratch(spark)
    except Exception:  # noqa: BLE001 - the session is gone, and its folder is left to the cluster
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{_own_scratch(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        context = spark.sparkContext
        if not getattr(context, "_prismarium_clears", False):
            atexit.register(_clear_at_exit, spark)
            context._prismarium_clears = True

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back. The shuffle files of the write go with its end, as nothing else reads them."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            self.spark.conf.set(_CLEANUP, "true")
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(self.spark, path)


class Cancellable:
    """Work of which only the latest result counts: starting anew, or `cancel`, ends the jobs of what ran before, whose result is then None."""

    def __init__(self, spark: SparkSession):
        self.spark, self.generation, self.lock = spark, 0, threading.Lock()
        self.name = f"prismarium-{uuid.uuid4().hex}"

    def cancel(self) -> int:
        with self.lock:
            self.spark.sparkContext.cancelJobGroup(f"{self.name}-{self.generation}")
            self.generation += 1
            return self.generation

    def run(self, work: Callable[[], T]) -> T | None:
        own = self.cancel()
        self.spark.sparkContext.setJobGroup(f"{self.name}-{own}", "cancellable", interruptOnCancel=True)
        try:
            result = work()
        except Exception:
            if own != self.generation:
                return None
            raise
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return result if own == self.generation else None


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_prismarium_shipped", False):
        return
    package = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp(prefix="prismarium-ship-")  # stays while the application runs, as executors fetch the file when they start
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(package, f"{tmp}/tree/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{tmp}/prismarium-{uuid.uuid4().hex[:8]}", "zip", f"{tmp}/tree"))
    context._prismarium_shipped = True
