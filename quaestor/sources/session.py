"""Tables of a data folder, and intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on one machine, as in tests, a temporary one, which is then
    set. On a cluster, where executors don't see the driver's folders, it has to be set."""
    sc = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quaestor-"))
    return sc.getCheckpointDir().rstrip("/")


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.dir}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quaestor_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing still to be computed reads."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._quaestor_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file over another."""
    place, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    store = lambda p: place(p).getFileSystem(conf)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store(source), place(source), store(target), place(target), False, True, conf)
