"""A table in a folder, replaced as a whole: each state is a numbered folder of its own, and counts only once it is complete.

A job that is lost while it writes leaves an incomplete number, which readers skip and the next publication overwrites; so a batch
job can be run again at any time. Earlier states stay until they are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARK = "_SUCCESS"


def _states(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete states, rising."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [int(n.removeprefix("state-")) for n in names if n.startswith("state-")]
    return sorted(n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(_path(folder, n), MARK)))


def _path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/state-{number:08d}"


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest complete state; None before the first."""
    states = _states(spark, folder)
    return spark.read.parquet(_path(folder, states[-1])) if states else None


def publish(df: DataFrame, folder: str) -> int:
    """Write df as the next state; gives its number. df may read the current one, which is left alone."""
    states = _states(df.sparkSession, folder)
    number = (states[-1] if states else 0) + 1
    df.write.mode("overwrite").parquet(_path(folder, number))
    return number


def drop_before(spark: SparkSession, folder: str, number: int) -> None:
    """Delete the states before a number, but never the newest complete one."""
    states = _states(spark, folder)
    for n in states[:-1]:
        if n < number:
            path = spark._jvm.org.apache.hadoop.fs.Path(_path(folder, n))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
