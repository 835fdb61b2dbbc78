"""Written stages and shared model files, kept in the folder that ``spark.checkpoint.dir`` names.

Every executor and the driver can reach that folder, so a stage that has been written outlives the executor that
made it. Python's own temporary folder is used only where the session names no folder and Spark runs in this one process
(a local test session); on a cluster a session without one is refused.
"""

from __future__ import annotations

import contextlib
import os
import resource
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; it is deleted when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/chobo-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    for folders in _scopes:
        folders.append(path)
    return path


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the folders that operators made within it: what they gave must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, *path.rsplit("/", 1))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""A session setting: the files of a query's shuffles are deleted as soon as it has ended."""


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``folder`` and read it back: lineage ends there.

    What was shuffled for it is not read again, so its files go at once and do not add up over an operator's stages.
    """
    path, spark = f"{folder}/{name}", df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a stage that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_array(path: str, array: np.ndarray) -> None:
    """Store an array as a plain binary file; a repeated attempt of a task replaces what an earlier one left."""
    array = np.ascontiguousarray(array)
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        part = f"{url.path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(memoryview(array).cast("B") if array.size else b"")
        os.replace(part, url.path)
        return
    fs, inner = _filesystem(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(memoryview(array).cast("B") if array.size else b"")
    fs.move(part, inner)


def map_array(path: str, dtype) -> np.ndarray:
    """Memory-map a stored array. A file in a remote store is first copied to the worker's disk and unlinked there."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        if os.path.getsize(url.path) == 0:
            return np.empty(0, dtype)
        return np.memmap(url.path, dtype=dtype, mode="r")
    fs, inner = _filesystem(path)
    with tempfile.NamedTemporaryFile() as own:
        with fs.open_input_stream(inner) as source:
            while block := source.read(1 << 22):
                own.write(block)
        own.flush()
        return np.memmap(own.name, dtype=dtype, mode="r") if os.path.getsize(own.name) else np.empty(0, dtype)


class Maps:
    """Stored arrays by path, memory-mapped. A map holds a file descriptor, so only so many stay open: a quarter of those
    that the process may have, and 8,192 at most. Readers go over all parts of a model again and again, in the same order;
    the first arrays therefore stay, and the others are mapped anew at each use, which a bound by last use would do to all.
    """

    def __init__(self, most: int | None = None) -> None:
        self.most = most or max(16, min(8192, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 4))
        self.open: dict[str, np.ndarray] = {}

    def get(self, path: str, dtype) -> np.ndarray:
        have = self.open.get(path)
        if have is None:
            have = map_array(path, dtype)
            if len(self.open) < self.most:
                self.open[path] = have
        return have


@contextlib.contextmanager
def stream(path: str, mode: str):
    """A file of the shared folder, read ("rb") or written ("wb") from end to end."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        if mode == "rb":
            with open(url.path, "rb") as f:
                yield f
            return
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        # what an earlier file there holds is written over, which is cheaper than to free it first
        with open(os.open(url.path, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            yield f
            f.truncate()
        return
    fs, inner = _filesystem(path)
    if mode == "wb":
        fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_input_stream(inner) if mode == "rb" else fs.open_output_stream(inner) as f:
        yield f


def random_access(path: str):
    """A file of the shared folder to seek and read in."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(url.path, "rb", buffering=1 << 18)
    fs, inner = _filesystem(path)
    return fs.open_input_file(inner)


def remove(path: str) -> None:
    """Delete a file of the shared folder."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.remove(url.path)
        return
    fs, inner = _filesystem(path)
    fs.delete_file(inner)
