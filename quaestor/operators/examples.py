"""Typed examples: options, targets, states, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import seeded
from ..sources.session import Workspace
from .ordered import numbered


def noul_target(p) -> Column:
    """The probabilities of no and yes."""
    return F.array((1.0 - p).cast("double"), p.cast("double"))


def rescaled(value: Column, top: float, k: int) -> Column:
    """A value up to `top` on levels 0 to k - 1."""
    return F.least(value / F.lit(top) * (k - 1), F.lit(float(k - 1)))


def score_target(value: Column, k: int) -> Column:
    """A fractional level shares its mass with the next one."""
    low = F.floor(value)
    part = value - low
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == low, 1 - part).when(i == low + 1, part).otherwise(0.0))


def shuffled(options: Column, seed, *keys: str) -> Column:
    """Options in an order that depends on the row's keys only."""
    order = lambda o: F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys), o), 256)
    return F.transform(F.sort_array(F.transform(options, lambda o: F.struct(order(o).alias("h"), o.alias("o")))), lambda x: x["o"])


def subset_with_gold(options: Column, gold: Column, n: int) -> Column:
    """The gold option and the first n - 1 others."""
    return F.concat(F.array(gold), F.slice(F.filter(options, lambda o: o != gold), 1, n - 1))


def anonymous(options: Column) -> Column:
    return F.transform(options, lambda o, i: F.struct(F.concat(F.lit("option_"), i.cast("string")).alias("key"), o.alias("desc")))


def picked(options: Column, seed, *keys: str) -> Column:
    n = F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("long")
    return F.get(options, (n % F.size(options)).cast("int"))


def class_weights(df: DataFrame, family: str, cls: str, cap: float = 3.0) -> DataFrame:
    """Per family and class min(cap, N / (K * n)), scaled so that a row's mean weight is 1."""
    counts = df.groupBy(family, cls).agg(F.count("*").alias("n"))
    w = Window.partitionBy(family)
    raw = F.least(F.lit(cap), F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))
    mean = F.sum(F.col("raw") * F.col("n")).over(w) / F.sum("n").over(w)
    return counts.withColumn("raw", raw).select(family, cls, (F.col("raw") / mean).alias("weight"))


def drawn_numbers(seed, keys: Sequence, wanted: Column, of: Column) -> Column:
    """`wanted` different numbers below `of` (or all, if fewer), each set as likely as any other, by hashes of the keys.

    Draw i is a number up to i, for i from of - wanted on; where that is taken already, it is i itself.
    """
    hashed = lambda i: F.conv(F.substring(seeded(seed, *keys, i), 1, 12), 16, 10).cast("long")

    def draw(taken: Column, i: Column) -> Column:
        number = hashed(i) % (i + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, number), i).otherwise(number)))

    first = F.greatest(of - wanted, F.lit(0)).cast("long")
    return F.aggregate(F.sequence(first, (of - 1).cast("long")), F.array().cast("array<long>"), draw)


def distractors(rows: DataFrame, catalog: DataFrame, item: str, gold: str, key: str, n: int, seed) -> DataFrame:
    """For each row n items of the catalog that aren't its own (all others, if fewer), any n of them as likely as others.

    Distinct items are numbered in their order. A row draws among the numbers of all items but its own, those from its own
    on being one higher. Only rows' numbers meet the catalog, by joins, whatever its size. Null items are none; rows whose
    gold item isn't in the catalog draw among all items, and rows of one key and item draw alike.
    """
    items = numbered(catalog.select(item).where(F.col(item).isNotNull()).distinct(), [item], "_no")
    items = Workspace(rows.sparkSession).write(items.select(F.col(item).alias("_item"), "_no"), "catalog")
    several = items.count()
    if not several:
        return rows.select(key, F.lit(None).cast(catalog.schema[item].dataType).alias(item)).limit(0)
    own = rows.select(key, gold).join(items, F.col(gold) == F.col("_item"), "left").select(key, F.coalesce("_no", F.lit(several)).alias("_own"))
    others = F.when(F.col("_own") < several, several - 1).otherwise(several)
    numbers = F.transform(drawn_numbers(seed, [key], F.lit(n), others), lambda x: x + (x >= F.col("_own")).cast("long"))
    each = own.where(others > 0).select(key, F.explode(numbers).alias("_no"))
    return each.join(items, "_no").select(key, F.col("_item").alias(item))


def prefix_states(turns: DataFrame, most: int) -> DataFrame:
    """The conversation so far at each user turn, up to that many turns; later turns are dropped before any is built."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = turns.select("conv_id", "turn", "role", "text", F.row_number().over(w).cast("long").alias("turns")).where(F.col("turns") <= most)
    said = F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "\n")
    return first.select("conv_id", "turn", "role", said.alias("state"), "turns").where(F.col("role") == "user")


def labels(n: int = 255) -> Column:
    """A to Z, then two letters from AA on."""
    letters = [chr(65 + i) for i in range(26)]
    return F.array(*map(F.lit, (letters + [a + b for a in letters for b in letters])[:n]))


def prompt(state: Column, instructions: Column, options: Column) -> Column:
    """State, question and one labelled line for each option; an option without a description shows its key."""
    lines = F.transform(options, lambda o, i: F.concat(F.get(labels(), i), F.lit(": "), F.coalesce(F.nullif(o["desc"], F.lit("")), o["key"])))
    return F.concat_ws("\n", F.lit("State:"), state, F.concat(F.lit("Question: "), instructions), F.array_join(lines, "\n"))


def question_fault(kind: Column, instructions: Column, n_options: Column) -> Column:
    """Why a question is not valid, or ok."""
    counts = F.when(kind == "choice", n_options.between(2, 255)).when(kind == "score", n_options.between(2, 10)).when(kind == "noul", n_options == 0)
    return F.when(counts.isNull(), "type").when(F.trim(instructions) == "", "instructions").when(~counts, "options").otherwise("ok")


def middle_cut(tokens: Column, limit: int) -> Column:
    """First and last half of the limit around a mark, where the tokens pass it."""
    half = limit // 2
    cut = F.concat_ws("\n", F.array_join(F.slice(tokens, 1, half), " "), F.lit("[...]"), F.array_join(F.slice(tokens, -(limit - half), limit - half), " "))
    return F.when(F.size(tokens) <= limit, F.array_join(tokens, " ")).otherwise(cut)
