"""Small files on the cluster's file system: pointers that are replaced in one step, and folders that are removed."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """Content of a pointer file, None where there is none."""
    system, at = _system(spark, path), _path(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_pointer(spark: SparkSession, path: str, content: str) -> None:
    """Write a file beside the pointer and rename it over; readers see the old content or the new one, never a part."""
    jvm, system = spark._jvm, _system(spark, path)
    beside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(beside, _path(spark, path), options)


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def holds(spark: SparkSession, path: str, start: str) -> bool:
    """Whether a folder is there and has an entry whose name begins like this; entries are looked at up to the first."""
    if not exists(spark, path):
        return False
    entries = _system(spark, path).listStatusIterator(_path(spark, path))
    while entries.hasNext():
        if entries.next().getPath().getName().startswith(start):
            return True
    return False
