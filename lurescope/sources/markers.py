"""Small files that are created once: the commit points of catalog and logs."""

from __future__ import annotations

import os
import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put_if_absent(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create the file with its whole text; false if it is there already.

    The text is written beside it first. On HDFS a rename never replaces a file; on local paths, where Hadoop's rename would, a
    hard link does the same. Both are atomic: of several writers one gets true, and no reader sees half a text. Stores
    without an atomic rename need a single writer.
    """
    files, target = _file(spark, path)
    files.mkdirs(target.getParent())
    if files.exists(target):
        return False
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if files.getUri().getScheme() != "file":
            return files.rename(draft, target)
        local = lambda p: files.makeQualified(p).toUri().getPath()
        os.link(local(draft), local(target))
        return True
    except (FileExistsError, Py4JJavaError):
        if files.exists(target):
            return False
        raise
    finally:
        if files.exists(draft):
            files.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _file(spark, path)
    source = files.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in the folder, hidden ones left out; none if there is no folder."""
    files, target = _file(spark, folder)
    if not files.exists(target):
        return []
    return [n for n in (s.getPath().getName() for s in files.listStatus(target)) if not n.startswith(("_", "."))]


def remove(spark: SparkSession, folder: str) -> bool:
    files, target = _file(spark, folder)
    return files.delete(target, True)
