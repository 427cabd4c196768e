"""Sinks beside Parquet: results that are appended to, CSV, lines by suffix and Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_results(planned: DataFrame, path: str, key: str, solve, done=None) -> DataFrame:
    """Appends solve(pending rows) to the results under a path, and gives all results, the last attempt of a key each.

    Results have the number of their attempt (`attempt`, from 1). Pending are planned rows of which the last attempt
    isn't there or, where `done` says which results are fine, isn't fine; so a run that was stopped goes on where it
    ended, and what failed is asked for again. Of results of one key and attempt the greatest counts.
    """
    spark = planned.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    todo, attempt = planned, 1
    if there:
        last = last_attempts(spark.read.parquet(path), key)
        fine = last if done is None else last.where(done)
        todo = planned.join(fine.select(key), key, "left_anti")
        attempt += spark.read.parquet(path).agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0]
    solve(todo).withColumn("attempt", F.lit(attempt).cast("long")).write.mode("append").parquet(path)
    return last_attempts(spark.read.parquet(path), key)


def last_attempts(results: DataFrame, key: str) -> DataFrame:
    """The last attempt of each key."""
    rest = [c for c in results.columns if c not in (key, "attempt")]
    last = results.groupBy(key).agg(F.max(F.struct("attempt", *rest)).alias("_r"))
    return last.select(key, *(F.col("_r")[c].alias(c) for c in [*rest, "attempt"]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="\\N").mode("errorifexists").csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.options(header=True, quote='"', escape='"', multiLine=True, emptyValue="", nullValue="\\N").schema(schema).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line, compressed if the path ends in .gz."""
    df.write.option("compression", "gzip" if path.rstrip("/").endswith(".gz") else "none").mode("errorifexists").json(path)


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """A report's rows as Markdown lines with their number, the header first; for results of few rows."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    spark = df.sparkSession
    head = spark.range(1).select(F.lit(0).cast("long").alias("n"), line([F.lit(c) for c in df.columns]).alias("line"))
    rule = spark.range(1).select(F.lit(1).cast("long").alias("n"), F.lit("|" + "-|" * len(df.columns)).alias("line"))
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    before = F.size(F.filter(F.col("_all"), lambda x: x < F.struct(*order)))
    every = df.agg(F.collect_list(F.struct(*order)).alias("_all"))  # the report's rows
    return head.unionByName(rule).unionByName(df.crossJoin(every).select((before + 2).cast("long").alias("n"), line(cells).alias("line")))
