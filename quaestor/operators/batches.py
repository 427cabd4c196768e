"""Batches of rows by their padded width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import Workspace
from .ordered import numbered


def token_budget(df: DataFrame, group: str, id_col: str, length_col: str, budget: int) -> DataFrame:
    """Rows of each group in the order of length and id; a batch ends when the next row's length times the rows with it
    would pass the budget. group, batch (from 0 in each group), row_id, length.

    Rows of one length are a run, of which a batch holds budget // length. A batch that begins in a run begins there
    at fewer places than it can hold; from a first place follow the run's other beginnings and, by a search along the
    runs, the first beginning in a later run. So the beginnings of all batches are a path in a table whose size depends
    on the budget and on how many lengths there are, and not on how many rows. The path is found by pointer doubling,
    and each row's batch is then arithmetic on its place in its run.

    A row longer than the budget is a batch of its own; rows of no length fit anywhere. Null lengths count as 0, null
    groups are a group, rows of one group, length and id are numbered in any order.
    """
    work = Workspace(df.sparkSession)
    rows = df.select(F.col(group).alias("g"), F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long").alias("length"), F.col(id_col).alias("row_id"))
    same = F.col("a.g").eqNullSafe(F.col("b.g"))
    rows = numbered(rows, ["g", "length", "row_id"])
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("length").rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy("g", "length").agg(F.count("*").alias("n"), F.min("position").alias("place"))
    fits = F.when(F.col("length") > 0, F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("length")))).otherwise(F.sum("n").over(Window.partitionBy("g")) + 1).cast("long")
    runs = runs.withColumns({"first": F.coalesce(upto, F.lit(0)), "fits": fits}).withColumn("last", F.col("first") + F.col("n") - 1)
    runs = work.write(runs, "runs")  # a row for each group and length
    # every place where the first batch of a run may begin; nothing comes before a group's first run
    places = F.when(F.col("first") == 0, F.lit(1)).otherwise(F.least("fits", "n"))
    starts = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("o"))
    starts = starts.withColumn("p", F.col("first") + F.col("o") + F.floor((F.col("n") - 1 - F.col("o")) / F.col("fits")) * F.col("fits"))
    # the next run with a beginning is the first whose last place less what a batch of it holds reaches p
    marks = runs.select("g", (F.col("last") - F.col("fits")).alias("p"), F.lit(1).alias("kind"), F.struct("length", "first", "fits").alias("run"), F.lit(None).cast("struct<length:bigint,o:bigint>").alias("at"))
    asked = starts.select("g", "p", F.lit(0).alias("kind"), F.lit(None).cast("struct<length:bigint,first:bigint,fits:bigint>").alias("run"), F.struct("length", "o").alias("at"))
    ahead = F.last("run", ignorenulls=True).over(Window.partitionBy("g").orderBy(F.desc("p"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    step = marks.unionByName(asked).withColumn("next", ahead).where("kind = 0 AND next IS NOT NULL")
    entry = F.greatest(F.col("next.first"), F.col("p") + F.col("next.fits")) - F.col("next.first")
    jump = work.write(step.select("g", "at", F.struct(F.col("next.length").alias("length"), entry.cast("long").alias("o")).alias("to")), "jumps")
    seen = work.write(runs.where("first = 0").select("g", F.struct("length", F.lit(0).cast("long").alias("o")).alias("at")), "seen")
    while not jump.isEmpty():  # as many rounds as the path's length has binary digits
        a, b = seen.alias("a"), jump.alias("b")
        more = a.join(b, same & (F.col("a.at") == F.col("b.at"))).select("a.g", F.col("b.to").alias("at"))
        a = jump.alias("a")
        twice = a.join(b, same & (F.col("a.to") == F.col("b.at"))).select("a.g", "a.at", "b.to")
        seen, old = work.write(seen.unionByName(more), "seen"), jump
        jump = work.write(twice, "jumps")
        work.drop(old)
    entered = seen.select("g", "at.length", "at.o").alias("a")
    found = runs.alias("b").join(entered, same & (F.col("a.length") == F.col("b.length")), "left").select("b.*", "a.o")
    begun = F.when(F.col("o").isNotNull(), F.floor((F.col("n") - 1 - F.col("o")) / F.col("fits")) + 1).otherwise(0)
    earlier = F.sum("begun").over(Window.partitionBy("g").orderBy("length").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("begun", begun).withColumn("earlier", F.coalesce(earlier, F.lit(0)))
    found = work.write(found.select("g", "length", "place", "fits", "o", "earlier"), "found")
    off = F.col("a.position") - F.col("b.place")
    batch = F.when(off >= F.col("b.o"), F.col("b.earlier") + F.floor((off - F.col("b.o")) / F.col("b.fits"))).otherwise(F.col("b.earlier") - 1)
    out = rows.alias("a").join(found.alias("b"), same & (F.col("a.length") == F.col("b.length")))
    return out.select(F.col("a.g").alias(group), batch.cast("long").alias("batch"), "a.row_id", "a.length")
