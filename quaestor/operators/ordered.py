"""Scans along one order over all rows, without one task for all rows: ranges, what each comes to, and places inside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import Workspace


def ranges(df: DataFrame, order: Sequence) -> DataFrame:
    """df in sorted ranges of about a partition each, written, with _range (ranges in order) and _at (place inside).

    Rows that are equal in all of `order` share a range; give a unique column last.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumns({"_range": F.shiftrightunsigned("_m", 33).cast("int"), "_at": F.col("_m").bitwiseAND((1 << 33) - 1)})
    return Workspace(df.sparkSession).write(placed.drop("_m"), "ranges")


def before_each(rows: DataFrame, total: Column, kind: str, combine) -> DataFrame:
    """_range and _before: what all ranges before one come to. One number a range passes through the driver."""
    each = sorted(rows.groupBy("_range").agg(total.alias("t")).collect())
    out, so_far = [], None
    for r in each:
        out.append((r["_range"], so_far))
        so_far = r["t"] if so_far is None else so_far if r["t"] is None else combine(so_far, r["t"])
    return rows.sparkSession.createDataFrame(out, f"_range int, _before {kind}")


def numbered(df: DataFrame, order: Sequence, name: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order."""
    rows = ranges(df, order)
    starts = before_each(rows, F.count("*"), "long", lambda a, b: a + b)
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_at")).drop("_range", "_at", "_before")


def least_before(df: DataFrame, value: str, order: Sequence, name: str = "best") -> DataFrame:
    """df with the least value of all rows before a row in the order; null for the first and where all were null."""
    rows = ranges(df, order)
    kind = dict(df.dtypes)[value]
    lows = before_each(rows, F.min(value), kind, min)
    inside = F.min(value).over(Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_inside", inside).join(F.broadcast(lows), "_range")
    return out.withColumn(name, F.least("_before", "_inside")).drop("_range", "_at", "_before", "_inside")


def percentiles(df: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """group, n and p (an array): exact percentiles of each group, between two values by their distance.

    Values are counted first, and counts are summed along ranges of (group, value), so that no task holds a group: a
    group's part in a range is a row. Null values don't count; a group without others has none.
    """
    counts = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy("_g", "_v").agg(F.count("*").alias("_n"))
    rows = ranges(counts, ["_g", "_v"])
    parts = rows.groupBy("_g", "_range").agg(F.sum("_n").alias("_m"))
    along = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("_g").alias("_h"), F.col("_range").alias("_s"), F.coalesce(F.sum("_m").over(along), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy("_g")).alias("n"))
    inside = F.sum("_n").over(Window.partitionBy("_range", "_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_upto", inside).join(starts, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_range") == F.col("_s")))
    upto, first = F.col("_before") + F.col("_upto"), F.col("_before") + F.col("_upto") - F.col("_n")
    at = lambda place: F.max(F.when((first <= place) & (place < upto), F.col("_v")))
    found = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("n") - 1)
        found += [at(F.floor(place)).alias(f"_a{i}"), at(F.ceil(place)).alias(f"_b{i}")]
    got = placed.groupBy("_g", "n").agg(*found)
    between = lambda i, share: F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (F.lit(share) * (F.col("n") - 1) - F.floor(F.lit(share) * (F.col("n") - 1)))
    return got.select(F.col("_g").alias(group), "n", F.array(*(between(i, s) for i, s in enumerate(shares))).alias("p"))
