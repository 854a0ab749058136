"""Folders that all executors share, and paths on any file system."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local master, whose
    executors are this machine, gets one of its own where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mathloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, renamed into place whole."""
    files, where = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out = files.create(part, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    files.delete(where, False)
    if not files.rename(part, where):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    size = files.getFileStatus(where).getLen()
    got = files.open(where)
    try:
        return bytes(got.readNBytes(size)).decode()
    finally:
        got.close()
