"""Small tables that are replaced as a whole while others read them.

A version is a folder of its own, and counts once its mark is there. The mark is made last, in one step, and a reader
takes the highest version with a mark; so it sees the old version or the new one, whole, wherever a writer stops. No
rename is needed, which some stores don't do in one step. The version before stays for those who still read it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MARK = "_committed"


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str, committed: bool = True) -> list[int]:
    fs, place = _store(spark, path)
    if not fs.exists(place(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place(path))]
    found = [int(m[1]) for m in map(re.compile(r"version-(\d+)").fullmatch, names) if m]
    return sorted(v for v in found if not committed or fs.exists(place(f"{path}/version-{v}/{MARK}")))


def write_version(df: DataFrame, path: str) -> int:
    """Writes the rows as a new version that nobody reads yet."""
    version = 1 + max(versions(df.sparkSession, path, committed=False), default=0)
    df.write.mode("errorifexists").json(f"{path}/version-{version}")
    return version


def commit(spark: SparkSession, path: str, version: int) -> None:
    """From now on readers see this version; refused where it has been committed already."""
    fs, place = _store(spark, path)
    fs.create(place(f"{path}/version-{version}/{MARK}"), False).close()


def clean(spark: SparkSession, path: str) -> None:
    """Deletes all that is older than the version before the newest."""
    fs, place = _store(spark, path)
    done = versions(spark, path)
    for v in versions(spark, path, committed=False):
        if len(done) > 1 and v < done[-2]:
            fs.delete(place(f"{path}/version-{v}"), True)


def replace(df: DataFrame, path: str) -> int:
    version = write_version(df, path)
    commit(df.sparkSession, path, version)
    clean(df.sparkSession, path)
    return version


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest committed version; no rows where there is none."""
    done = versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/version-{done[-1]}") if done else spark.createDataFrame([], schema)
