"""Counts and fingerprints of tables, and sinks that write them beside the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """kind, value, n for each value of each column, from one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns))).alias("e")
    return df.select(pairs).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and a checksum that doesn't depend on their order."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(row).alias("checksum"))


def write_splits(df: DataFrame, path: str, split: str, seed) -> None:
    """One folder for each split, rows in hashed order within files; an existing path is refused."""
    from ..functions.keys import seeded

    ordered = df.repartition(split, F.pmod(F.xxhash64(*df.columns), F.lit(16))).sortWithinPartitions(split, seeded(seed, *[c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]))
    ordered.write.partitionBy(split).mode("errorifexists").json(path)


def file_checksums(spark, path: str) -> DataFrame:
    """file (relative to the path), bytes and sha256 of every file under it, worked out where the files are read; a
    file has to fit in a task's memory."""
    top = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.concat_ws("/", F.slice(F.split("path", "/"), F.lit(_depth(spark, path) + 1), F.lit(1 << 20)))
    return top.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _depth(spark, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return len(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/").split("/"))


def file_manifest(rows: DataFrame, path: str) -> DataFrame:
    """file, rows, bytes, sha256 of the files under a path, `rows` being what a reader makes of them; files without
    rows have 0."""
    spark = rows.sparkSession
    parts = F.split("_metadata.file_path", "/")  # file:/// has two more slashes than file:/
    extra = F.size(F.split(F.regexp_extract("_metadata.file_path", "^[a-z0-9]+:(/*)", 1), "/")) - 2
    name = F.concat_ws("/", F.slice(parts, F.lit(_depth(spark, path) + 1) + F.greatest(extra, F.lit(0)), F.lit(1 << 20)))
    held = rows.select(name.alias("file")).groupBy("file").agg(F.count("*").alias("n"))
    return file_checksums(spark, path).join(held, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("rows"), "bytes", "sha256")


def changed_files(spark, path: str, manifest: DataFrame) -> DataFrame:
    """file and what became of it since the manifest: changed, missing or new."""
    was, now = manifest.select("file", F.col("sha256").alias("was")), file_checksums(spark, path).select("file", F.col("sha256").alias("now"))
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").otherwise("changed")
    return was.join(now, "file", "full").where("NOT was <=> now").select("file", kind.alias("kind"))


def write_manifest(df: DataFrame, path: str, columns: Sequence[str], seed, limitations: Sequence[str] = ()) -> None:
    """One JSON row: counts, fingerprint, seed and limitations."""
    facts = fingerprint(df, df.columns).select(F.struct("n", "checksum").alias("table"))
    named = counts(df, columns).agg(F.collect_list(F.struct("kind", "value", "n")).alias("counts"))
    facts.crossJoin(named).withColumn("seed", F.lit(str(seed))).withColumn("limitations", F.array(*map(F.lit, limitations)).cast("array<string>")).coalesce(1).write.mode("errorifexists").json(path)
