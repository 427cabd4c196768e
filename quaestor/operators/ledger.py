"""A ledger of protected keys that grows from run to run, bucketed by key so that no join has to shuffle it."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Distinct keys under a path, each with the source that it first came from.

    The table is bucketed and sorted by key; opened again, in this session or another, it goes on with the same
    number of buckets. Joins with it are merge joins for which only the other side moves.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.name = spark, f"ledger_{sha256(path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, source STRING) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, keys: DataFrame, source: str) -> int:
        """Adds those of the keys (column key) that aren't there; gives how many those were. Nulls are none."""
        new = keys.select("key").where("key IS NOT NULL").distinct().join(self.keys().hint("merge"), "key", "left_anti")
        before = self.keys().count()
        new.select("key", F.lit(source).alias("source")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.keys().count() - before

    def exclude(self, df: DataFrame, id_col: str, keys: Column) -> DataFrame:
        """Rows of df of which no key is in the ledger; rows of one id go together."""
        each = df.select(F.col(id_col).alias("_id"), F.explode(keys).alias("key"))
        hit = each.join(self.keys().hint("merge"), "key", "left_semi").select("_id").distinct()
        return df.join(hit, F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
