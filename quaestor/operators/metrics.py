"""Metrics of probability vectors p against target vectors t."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: 121 temperatures from 0.25 to 8, evenly spaced by their logarithms.
GRID = [math.exp(math.log(0.25) + i * (math.log(8) - math.log(0.25)) / 120) for i in range(121)]


def hit(p="p", t="t") -> Column:
    return (V.argmax(p) == V.argmax(t)).cast("double")


def report(df: DataFrame, sets: Sequence[Sequence[str]], p: str = "p", t: str = "t") -> DataFrame:
    """n, accuracy, nll and brier for each grouping set."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    rows = df.select(*names, hit(p, t).alias("hit"), V.nll(p, t).alias("nll"), V.brier(p, t).alias("brier"))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"))


def calibration_error(df: DataFrame, by: Sequence[str] = (), bins: int = 10, p: str = "p", t: str = "t") -> DataFrame:
    """Bins are open below and closed above, so a confidence of 0 is in none; weights are shares of all rows."""
    top = F.array_max(p)
    rows = df.select(*by, top.alias("top"), hit(p, t).alias("hit"), (F.ceil(top * bins) - 1).alias("bin"))
    per = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("top").alias("conf"), F.avg("hit").alias("acc"))
    gap = F.when(F.col("bin") >= 0, F.col("n") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0)
    return per.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ordinal(df: DataFrame, k: int, by: Sequence[str] = (), p: str = "p", t: str = "t") -> DataFrame:
    """Mean absolute error of the expected level on 0 to 1, and the share within one level of the expected target."""
    e, g = V.expected_level(p), V.expected_level(t)
    rows = df.select(*by, (F.abs(e - g) / (k - 1)).alias("mae"), (F.abs(V.argmax(p) - g) <= 1).cast("double").alias("near"))
    return rows.groupBy(*by).agg(F.avg("mae").alias("mae"), F.avg("near").alias("within_one"))


def average_rank(value: str, *by: str) -> Column:
    """Ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Null for two rows or fewer and for a constant y."""
    ranked = df.select(*by, y, average_rank(x, *by).alias("rx"), average_rank(y, *by).alias("ry"))
    return ranked.groupBy(*by).agg(F.when((F.count("*") > 2) & (F.stddev_pop(y) > 0), F.corr("rx", "ry")).alias("spearman"))


def best_temperature(df: DataFrame, by: Sequence[str], z: str = "z", t: str = "t") -> DataFrame:
    """The temperature of the grid with the least mean nll, the first of equals, to 4 decimals."""
    grid = F.explode(F.array(*map(F.lit, GRID))).alias("temperature")
    rows = df.select(*by, z, t, grid).select(*by, "temperature", V.nll(V.softmax(z, F.col("temperature")), t).alias("nll"))
    means = rows.groupBy(*by, "temperature").agg(F.avg("nll").alias("nll"))
    return means.groupBy(*by).agg(F.round(F.min_by("temperature", F.struct(F.round("nll", 9), "temperature")), 4).alias("temperature"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return 2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)


def binary_counts(gold: Column, said: Column) -> list[Column]:
    return [F.count_if(gold & said).alias("tp"), F.count_if(~gold & said).alias("fp"), F.count_if(gold & ~said).alias("fn")]


def macro_f1(df: DataFrame, gold: str, said: str, by: Sequence[str] = ()) -> DataFrame:
    """Over the classes that are gold or predicted; a class that is never gold counts 0."""
    each = df.select(*by, F.explode(F.array_distinct(F.array(gold, said))).alias("c"), gold, said)
    g, s = F.col(gold) == F.col("c"), F.col(said) == F.col("c")
    per = each.groupBy(*by, "c").agg(*binary_counts(g, s))
    return per.groupBy(*by).agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), F.count("*").alias("classes"))


LISTED = 1_000_000  # values that are listed by stratum and sent to all tasks, at most


def bootstrap_interval(df: DataFrame, stratum: str, row: str, value: str, draws: int, seed) -> DataFrame:
    """The mean and the 95 % interval of means of stratified resamples.

    Draw j takes for each row of a stratum the row at a place that a hash of draw and row gives, so both engines
    draw alike. Places are ranks within strata. Up to LISTED values, each task has the strata's lists and looks places
    up; beyond that, draws and values meet by a join.
    """
    w = Window.partitionBy(stratum)
    ranked = df.select(stratum, row, value, (F.row_number().over(w.orderBy(row)) - 1).alias("at"), F.count("*").over(w).alias("m"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("j").cast("string"), F.col(row).cast("string"))), 1, 8), 16, 10).cast("long")
    each = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("j")
    if df.count() <= LISTED:
        lists = ranked.groupBy(stratum).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))
        tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
        some = -(-draws // (4 * tasks))  # draws that a row makes in one go
        dealt = ranked.select(stratum, "m", row, F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(some))).alias("lo")).repartition(tasks, "lo", row)
        each = F.explode(F.sequence("lo", F.least(F.col("lo") + some, F.lit(draws)) - 1)).alias("j")
        drawn = dealt.join(F.broadcast(lists), stratum).select(row, "m", "values", each).select("j", F.get("values", (hashed % F.col("m")).cast("int")).alias(value))
    else:
        drawn = ranked.select(stratum, "m", row, each).select(stratum, "j", (hashed % F.col("m")).alias("at")).join(ranked.select(stratum, "at", value), [stratum, "at"])
    means = drawn.groupBy("j").agg(F.avg(value).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return df.agg(F.avg(value).alias("delta")).crossJoin(ends)
