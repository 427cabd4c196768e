"""Whole examples from sources of different layouts: state, question with its options, and target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import examples as X
from .selection import hash_limit


@dataclass(frozen=True)
class Source:
    """Where examples come from. `rows` is a query that gives id, state, gold (a choice's key) and value (a score from 0
    to the last level, or the share of yes); tables stand in braces. Options are keys with descriptions, or levels."""

    name: str
    kind: str  # choice, score or noul
    instructions: str
    options: Sequence[tuple[str, str]]
    rows: str
    quota: int


COLUMNS = ["source", "type", "id", "state", "instructions", "options", "target"]


def examples(spark, source: Source, tables: dict[str, DataFrame], seed) -> DataFrame:
    """A source's examples up to its quota, in a seeded order: source, type, id, state, instructions, options (key and
    desc, of a choice in an order of the row's own) and target, a share for each option (no and yes without options).

    Rows without a state or without a gold or value that the options allow are left out.
    """
    used = {k: v for k, v in tables.items() if f"{{{k}}}" in source.rows}
    rows = spark.sql(source.rows, **used).select(F.col("id").cast("long").alias("id"), "state", F.col("gold").cast("string").alias("gold"), F.col("value").cast("double").alias("value"))
    n = len(source.options)
    option = lambda k, d: F.struct(F.lit(k).alias("key"), F.lit(d).alias("desc"))
    every = F.array(*(option(k, d) for k, d in source.options)) if n else F.array().cast("array<struct<key:string,desc:string>>")
    if source.kind == "choice":
        keys = [k for k, _ in source.options]
        rows = rows.where(F.col("gold").isin(keys))
        described = F.create_map(*(F.lit(x) for pair in source.options for x in pair))
        order = X.shuffled(F.array(*map(F.lit, keys)), f"{seed}|{source.name}", "id")
        options = F.transform(order, lambda k: F.struct(k.alias("key"), described[k].alias("desc")))
        target = F.transform(F.col("options"), lambda o: (o["key"] == F.col("gold")).cast("double"))
    elif source.kind == "score":
        rows, options = rows.where(F.col("value").between(0, n - 1)), every
        target = X.score_target(F.col("value"), n)
    else:
        rows, options = rows.where(F.col("value").between(0, 1)), every
        target = F.array(1 - F.col("value"), F.col("value"))
    chosen = hash_limit(rows.where("state IS NOT NULL AND id IS NOT NULL"), source.quota, f"{seed}|{source.name}", "id")
    named = {"source": F.lit(source.name), "type": F.lit(source.kind), "instructions": F.lit(source.instructions), "options": options}
    return chosen.withColumns(named).withColumn("target", target).select(*COLUMNS)


def build(spark, sources: Sequence[Source], tables: dict[str, DataFrame], seed) -> DataFrame:
    return reduce(DataFrame.unionByName, (examples(spark, s, tables, seed) for s in sources))
