"""Small files and folders of the shared file system, whatever it is (Hadoop file systems, local files)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file; it appears under its name only when it is whole."""
    fs, where = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(path + ".draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not fs.rename(draft, where):
        raise OSError(f"cannot write {path}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a whole folder; a missing one is no error."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
