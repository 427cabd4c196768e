"""Dedup, exclusion, splits and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import col, seeded


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def exclude_overlap(df: DataFrame, keys: Column, blocked: DataFrame, blocked_key: str, id_col: str) -> DataFrame:
    """Rows of which no key is blocked."""
    hit = df.select(id_col, F.explode(keys).alias("_k")).join(blocked.select(F.col(blocked_key).alias("_k")).distinct(), "_k", "left_semi").select(id_col).distinct()
    return df.join(hit, id_col, "left_anti")


def keep_whole_groups(df: DataFrame, group: str, passes: Column) -> DataFrame:
    """Rows of groups every member of which passes."""
    good = df.groupBy(group).agg(F.bool_and(passes).alias("_ok")).where("_ok").select(group)
    return df.join(good, group, "left_semi")


def split_by(bucket: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    """The name of the first cut above the bucket."""
    out = F.lit(last)
    for edge, name in reversed(cuts):
        out = F.when(bucket < edge, name).otherwise(out)
    return out


def hash_limit(df: DataFrame, n: int, seed, *keys: str, within: Sequence[str] = ()) -> DataFrame:
    """The first n rows (of each group) in hashed order."""
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(seeded(seed, *keys), *keys)) if within else None
    if rank is None:
        return df.orderBy(seeded(seed, *keys), *keys).limit(n)
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def salted_first(df: DataFrame, within: Sequence[str], order: Sequence, limit: int, keys: Sequence[str], parts: int = 64) -> DataFrame:
    """Rows among which are the first `limit` of each group, at most parts * limit of a group: a hash of the keys deals each
    group over parts, and each part keeps its own first ones. No task sorts a whole group."""
    dealt = df.withColumn("_p", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    rank = F.row_number().over(Window.partitionBy(*within, "_p").orderBy(*order))
    return dealt.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r", "_p")


def round_robin(df: DataFrame, within: Sequence[str], cls: str, limit: int, seed, *keys: str) -> DataFrame:
    """One row of each class in turn until the limit, without replacement."""
    df = salted_first(df, [*within, cls], [seeded(seed, *keys), *keys], limit, keys)
    turn = F.row_number().over(Window.partitionBy(*within, cls).orderBy(seeded(seed, *keys), *keys))
    # no class can give more than the limit, so the second window meets at most classes * limit rows a group
    ranked = df.withColumn("_turn", turn).where(F.col("_turn") <= limit)
    place = F.row_number().over(Window.partitionBy(*within).orderBy("_turn", cls))
    return ranked.withColumn("_place", place).where(F.col("_place") <= limit).drop("_turn", "_place")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The last write of each key wins."""
    return first_by(df, keys, [col(o).desc() for o in order])


def owned_twice(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that lie in several splits."""
    return df.groupBy(key).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select(key)


def first_reason(reasons: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The first reason that applies to a row."""
    out = F.lit(kept)
    for name, test in reversed(list(reasons)):
        out = F.when(test, name).otherwise(out)
    return out


def cover(df: DataFrame, stratum: str, special: Column, order: Sequence[str], id_col: str, limit: int) -> DataFrame:
    """The first row of each stratum, one more special row, then the rest in the order, up to the limit.

    Strata that are more than the limit give the first ones in the order. Ids are unique and not null.
    """
    place = F.struct(*order, F.col(id_col).alias("_id"))
    firsts = df.groupBy(stratum).agg(F.min(place).alias("_f")).select("_f._id", F.lit(0).alias("_turn"))
    others = df.where(special).join(firsts, F.col(id_col) == F.col("_id"), "left_anti")
    one = others.agg(F.min(place).alias("_f")).where("_f IS NOT NULL").select("_f._id", F.lit(1).alias("_turn"))
    ranked = df.join(firsts.unionByName(one), F.col(id_col) == F.col("_id"), "left")
    return ranked.orderBy(F.coalesce("_turn", F.lit(2)), *order).limit(limit).drop("_id", "_turn")
