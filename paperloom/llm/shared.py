"""The folder that driver and executors share, and what the operators keep in it.

The folder is ``spark.checkpoint.dir`` as the session has it. Only where it is unset (tests, a
laptop) a temporary one is made and set, and only for a local master: on a cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def tidied() -> Iterator[Callable[[], None]]:
    """What is made below in this thread is noted; the function given removes all of it but what was made last."""
    token = _made.set([])

    def tidy() -> None:
        made = _made.get()
        for uri in made[:-1]:
            filesystem, path = _filesystem(uri)
            filesystem.delete_dir(path)
        del made[:-1]

    try:
        yield tidy
    finally:
        _made.reset(token)


def _new(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared one; files in it are written by tasks."""
    path = _new(spark, name)
    filesystem, local = _filesystem(path)
    filesystem.create_dir(local, recursive=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, computed once and read again from the shared folder: cuts the lineage."""
    path = _new(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(uri: str):
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes | memoryview | np.ndarray) -> None:
    """Write one file whole: a task that runs again, or twice at once, leaves the same file."""
    filesystem, path = _filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part) as out:
        out.write(memoryview(np.ascontiguousarray(data)).cast("B") if isinstance(data, np.ndarray) else data)
    filesystem.move(part, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """An array file: memory-mapped where the shared folder is a mounted path, else read."""
    filesystem, path = _filesystem(uri)
    if os.path.exists(path):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with filesystem.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype=dtype)


def opened(uri: str):
    """A random-access file of the shared folder."""
    filesystem, path = _filesystem(uri)
    return filesystem.open_input_file(path)


def stream(uri: str):
    """A sink for one new file; the caller moves it with `finish` when it is whole."""
    filesystem, path = _filesystem(uri)
    return filesystem.open_output_stream(path)


def finish(part: str, uri: str) -> None:
    filesystem, path = _filesystem(part)
    filesystem.move(path, _filesystem(uri)[1])


def listed(uri: str) -> list[str]:
    """URIs of the files of a folder of the shared one, in the order of their names."""
    from pyarrow import fs

    filesystem, path = _filesystem(uri)
    names = [x.base_name for x in filesystem.get_file_info(fs.FileSelector(path)) if x.is_file]
    return [f"{uri}/{name}" for name in sorted(names) if not name.endswith(".part")]
