"""What a loop over rows in order would take, in parallel rounds: a row is taken unless a row taken before it holds one of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col
from ..sources.session import Workspace


def first_without_shared_keys(df: DataFrame, id_col: str, keys: Column, order, held: DataFrame | None = None) -> DataFrame:
    """Ids of the rows that a loop in the order (then by id) takes, when each taken row bars all later rows of its keys.

    In each round an undecided row that comes first for all of its keys is taken, since nothing undecided can bar it
    any more, and the other holders of its keys are decided against. Rounds are as many as the longest chain of rows that
    wait for each other: few in a hashed order. A key's first row is found by a map-side combined minimum, so that a key in a third of all rows costs
    a row a task. `held` has keys (column `key`) that bar from the start. Null keys bar nothing, rows without keys are
    taken, and rows of one id are one row with the least order and the keys of all.
    """
    work = Workspace(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), col(order).alias("o"), F.array_distinct(F.filter(F.coalesce(keys, F.array()), lambda k: k.isNotNull())).alias("keys")).where("id IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min("o").alias("o"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    rows = work.write(rows, "rows")
    taken = [rows.where("size(keys) = 0").select("id")]
    live = rows.select("id", "o", F.explode("keys").alias("key"))
    if held is not None:
        live = _without(live, live.join(held.select("key"), "key", "left_semi"))
    live = work.write(live, "live")
    while not live.isEmpty():
        sizes = live.groupBy("id").agg(F.count("*").alias("n"))
        first = live.groupBy("key").agg(F.min(F.struct("o", "id")).alias("first")).select("key", "first.id")
        first = work.write(first, "first")
        now = first.groupBy("id").agg(F.count("*").alias("firsts")).join(sizes, "id").where("firsts = n").select("id")
        now = work.write(now, "taken")
        taken.append(now)
        closed = first.join(now, "id", "left_semi").select("key")  # each key of a taken row has that row first
        left = work.write(_without(live, live.join(closed, "key", "left_semi")), "live")
        work.drop(live, first)
        live = left
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select(F.col("id").alias(id_col))


def _without(live: DataFrame, hit: DataFrame) -> DataFrame:
    """Rows (with all of their keys) that aren't hit through any key."""
    return live.join(hit.select("id").distinct(), "id", "left_anti").select("id", "o", "key")
