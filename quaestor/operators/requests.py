"""Requests of several questions, ensembles by key, capacity of whole requests, and counts and joins that must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .manifest import fingerprint


def asked(requests: DataFrame, request: str, questions: str) -> DataFrame:
    """A row for each question of a request: a map of names to questions becomes name and question."""
    others = [c for c in requests.columns if c != questions]
    return requests.select(*others, F.explode(questions).alias("name", "question"))


def answered(rows: DataFrame, request: str, answer: str) -> DataFrame:
    """Answers of one request as a map by the names of its questions."""
    return rows.groupBy(request).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", answer)))).alias("answers"))


def ensemble_by_key(keys: Column, p: Column, other_keys: Column, q: Column) -> Column:
    """The mean of two distributions by option key, in the order of the first, scaled to 1; null unless both have the
    same keys and are finite, not negative and of positive mass. Keys are compared as they are."""
    fine = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (x >= 0) & (x < float("inf"))) & (V.total(v) > 0)

    def mean(keys, p, other_keys, q):
        same = (F.size(keys) == F.size(other_keys)) & (F.sort_array(keys) == F.sort_array(other_keys)) & (F.size(keys) == F.size(p)) & (F.size(other_keys) == F.size(q))
        both = F.zip_with(keys, p, lambda k, x: (x + F.get(q, (F.array_position(other_keys, k) - 1).cast("int"))) / 2)
        return F.when(same & fine(p) & fine(q), V.normalised(both))

    return V.bound(keys, lambda k: V.bound(p, lambda x: V.bound(other_keys, lambda j: V.bound(q, lambda y: mean(k, x, j, y)))))


def fitting_requests(rows: DataFrame, request: str, tokens: Column, limit: int) -> DataFrame:
    """Rows of requests of which every row keeps to the limit; nothing is cut."""
    whole = rows.groupBy(request).agg(F.bool_and(F.coalesce(tokens <= limit, F.lit(False))).alias("_fits")).where("_fits").select(request)
    return rows.join(whole, request, "left_semi")


def at_least(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Counts of groups; the job fails when one has fewer than n rows."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    short = F.concat(F.lit("too few rows in "), F.coalesce(F.col(group).cast("string"), F.lit("null")))
    return counts.select(group, F.when(F.col("n") >= n, F.col("n")).otherwise(F.raise_error(short).cast("long")).alias("n"))


def quota(rows: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group; the job fails when a group has fewer."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    found = at_least(ranked.where(F.col("_r") <= n), group, n).select(F.col(group).alias("_g"), "n")
    return ranked.where(F.col("_r") <= n).join(found, F.col(group).eqNullSafe(F.col("_g"))).where("n > 0").drop("_r", "_g", "n")


def total_lookup(rows: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the value of their key; the job fails where there is none."""
    joined = rows.join(found.select(F.col(key).alias("_k"), F.col(value).alias("_v")), F.col(key) == F.col("_k"), "left")
    missing = F.raise_error(F.concat(F.lit("no value for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(value, F.when(F.col("_k").isNotNull(), F.col("_v")).otherwise(missing.cast(found.schema[value].dataType))).drop("_k", "_v")


def failure_streaks(rows: DataFrame, group: str, order: str, failed: Column) -> DataFrame:
    """group, first, length of each run of failures that follow each other."""
    w = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("_f", failed).withColumn("_island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    return marked.where("_f").groupBy(group, "_island").agg(F.min(order).alias("first"), F.count("*").alias("length")).drop("_island")


def label_audit(rows: DataFrame, native: DataFrame, key: str, label: str, derived: str) -> DataFrame:
    """Rows whose label isn't the one derived from their source, which is null where the source lacks the row."""
    found = native.select(F.col(key).alias("_k"), F.col(derived))
    return rows.select(key, label).join(found, F.col(key) == F.col("_k"), "left").where(~F.col(label).eqNullSafe(F.col(derived))).drop("_k")


def reused(rows: DataFrame, earlier: DataFrame, key: str, payload: str, status: str, good: str, value: str) -> DataFrame:
    """Rows with an earlier run's value. The job fails for a row that the earlier run hasn't, whose payload differs, or
    whose earlier answer isn't good."""
    old = earlier.select(F.col(key).alias("_k"), F.col(payload).alias("_p"), F.col(status).alias("_s"), F.col(value).alias("_v"))
    fault = F.when(F.col("_k").isNull(), "is missing").when(~F.col(payload).eqNullSafe(F.col("_p")), "has another payload").when(~F.col("_s").eqNullSafe(F.lit(good)), "failed")
    stop = F.raise_error(F.concat(F.lit("earlier result of "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" "), fault))
    joined = rows.join(old, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(value, F.when(fault.isNull(), F.col("_v")).otherwise(stop.cast(earlier.schema[value].dataType))).drop("_k", "_p", "_s", "_v")


def checked_lookup(rows: DataFrame, found: DataFrame, key: str, value: str, train: DataFrame, said: tuple) -> DataFrame:
    """Rows with the value of their key, for values made from `train`: refused unless its fingerprint (rows, checksum) is
    the one that was noted with them. The job fails where a key has no value."""
    now = tuple(fingerprint(train, train.columns).first())
    if now != tuple(said):
        raise ValueError(f"values were made from other rows: {tuple(said)}, now {now}")
    return total_lookup(rows, found, key, value)


def over_capacity(query: Column, state: Column, options: Column, most: tuple[int, int, int]) -> Column:
    """Which cap a request passes, by characters: its query's, its state's as JSON, or that of all its options together; else ok."""
    together = F.aggregate(options, F.lit(0), lambda n, o: n + F.coalesce(F.length(o), F.lit(0)))
    return F.when(F.length(query) > most[0], "query").when(F.length(state) > most[1], "state").when(together > most[2], "options").otherwise("ok")
