"""Small files and folders of a run on whatever file system their paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths a pattern matches, sorted."""
    p, fs = _at(spark, pattern)
    found = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in found) if found is not None else []


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str, exist_ok: bool = True) -> str:
    p, fs = _at(spark, path)
    if not exist_ok and fs.exists(p):
        raise FileExistsError(path)
    fs.mkdirs(p)
    return path


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf8")))
    finally:
        stream.close()
    return path


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]
