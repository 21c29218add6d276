"""Folders of the shared file system: looked at, moved and removed through the session's own file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, system = _at(spark, folder)
    return system.exists(path)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all in it; nothing where there is none."""
    path, system = _at(spark, folder)
    system.delete(path, True)


def moved(spark: SparkSession, folder: str, to: str) -> bool:
    """Rename a folder; False where the target is there already."""
    path, system = _at(spark, folder)
    target = _at(spark, to)[0]
    if system.exists(target):
        return False
    system.mkdirs(target.getParent())
    return system.rename(path, target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, in order of name."""
    path, system = _at(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []
