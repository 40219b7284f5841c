"""Byte ranges of files, read in tasks by Arrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import SparkSession


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if ":/" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    scheme, rest = path.split(":", 1)
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)


def readable(path: str) -> bool:
    """Whether tasks can open the path themselves; Spark may know file systems that Arrow does not."""
    try:
        file_system(path)
    except (OSError, ValueError):
        return False
    return True


def listed(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder, or the file itself, in order; hidden ones don't count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in at.listStatus(p) if s.isFile()] if at.getFileStatus(p).isDirectory() else [path]
    return sorted(f for f in found if not f.rsplit("/", 1)[-1].startswith((".", "_")))


def size_of(path: str) -> int:
    at, name = file_system(path)
    return at.get_file_info(name).size


def cut(path: str, start: int, end: int) -> bytes:
    """Bytes from start to end, or to the file's end."""
    at, name = file_system(path)
    with at.open_input_file(name) as f:
        return f.read_at(max(0, min(end, f.size()) - start), start) if start < f.size() else b""
