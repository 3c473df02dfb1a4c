"""What operators need from a session: shipped code and a shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()


#: Rows of an Arrow batch where the session leaves Spark's own number; rows here hold whole texts.
BATCH = 2000


def tidy(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """function for mapInArrow that gives the memory it no longer needs back to the system when a task ends.

    Workers are used again and wait between tasks; without this each one keeps what its largest task took.
    """

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            released()

    return tidied


def released() -> None:
    """Give memory that is no longer used back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, and batches small; done once per application."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    with _LOCK:
        if getattr(sc, "_keepset_shipped", False):
            return
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="keepset-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "keepset.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent).as_posix())
        sc.addPyFile(archive)
        sc._keepset_shipped = True


def quoted(name: str) -> str:
    """A column's name as Spark's functions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such column."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_keepset_folder", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="keepset-scratch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext._keepset_folder = folder
    return folder


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive lost executors.

    Tables that a returned DataFrame still reads stay until release_all() or the end of the application;
    drop() removes one as soon as nothing reads it.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/keepset-{name}-{uuid.uuid4().hex[:12]}"
        Scratch._open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back. Its shuffle files go as soon as it is written."""
        with self.cleaning():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    @contextlib.contextmanager
    def cleaning(self):
        """Queries that run inside leave no shuffle files behind."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, before)

    def drop(self, name: str) -> None:
        self._delete(self.path(name))

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        self._delete(self.root)
        Scratch._open.remove(self)


def release_all() -> None:
    """Remove every scratch table; call it once all results that read them are written."""
    for scratch in list(Scratch._open):
        try:
            scratch.release()
        except Exception:  # the application may have ended
            Scratch._open.remove(scratch)


atexit.register(release_all)
