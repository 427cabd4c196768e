"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in the shard that its id's hash gives. The documents
of a group that start in one shard form a block, so a group has at most as many blocks as there are shards, however
many copies it holds. A group's homes are the shards that hold most of it, as many as it could fill. In each round, joins
give each block outside its group's homes one of them, and it asks to move there; quotas for each pair of shards, worked
out from how many documents ask, let in as many as keep every shard to FULL times its share.

Then counts are made equal to one row. A part of a group in one shard is a unit. Units stay, the largest first, as far
as they fit into their shard's share; the others, and then documents without links, are laid one after the other along
the places that are left. So only a group larger than a shard, and one unit at the end of each shard's free places, are
divided.

The law is `rows`: shards' counts are at most one apart. All of it is built-in functions; what meets the driver has a row
for each pair of shards, what is broadcast one for each shard, power of two and bucket. A bucket, which one task sorts, has about
ROWS rows; there are as many as that takes, and at least BUCKETS.

A null text has no bytes and counts as equal to the empty one. Repeated rows are separate documents; rows without an id
start anywhere; columns besides the id and the text are not read; a table without rows gives none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import Workspace

SHARDS, ROUNDS, BUCKETS, FULL = 40, 12, 512, 2.0
ROWS = 1_000_000


def _bucket(*cols, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _list(values: list, kind: str = "long") -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _of(values: list[int], shard: Column) -> Column:
    """The shard's entry of a list with one entry for each shard."""
    return F.element_at(_list(values), shard + 1)


def _buckets(rows: int) -> int:
    """How many buckets so many rows take."""
    return max(BUCKETS, -(-rows // ROWS))


def _before(rows: DataFrame, within: list[str], order: list[str], size: Column, n: int = BUCKETS) -> DataFrame:
    """Adds `before`: the sum of sizes of rows that come before, by `order` (few values) and then by bucket and `key`.

    Rows are summed in groups of `within`, `order` and a bucket; the groups' sums are added up beside.
    """
    rows = rows.withColumn("_b", _bucket(F.lit(17), "key", n=n)).withColumn("_n", size)
    places = [*within, *order, "_b"]
    sums = rows.groupBy(*places).agg(F.sum("_n").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order, "_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")
    sums = sums.select(*(F.col(c).alias(f"_of_{c}") for c in places), upto.alias("_first"))
    inside = F.sum("_n").over(Window.partitionBy(*places).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    same = [F.col(c) == F.col(f"_of_{c}") for c in places]
    joined = rows.withColumn("_in", inside).join(F.broadcast(sums), same)
    return joined.withColumn("before", F.col("_first") + F.col("_in")).drop("_b", "_n", "_in", "_first", *(f"_of_{c}" for c in places))


def quotas(held: list[int], asked: list[list[int]], most: float) -> list[list[float]]:
    """For each pair of shards the share of askers to let in, so that no shard that others enter passes `most`."""
    n = len(held)
    let = [[1.0] * n for _ in range(n)]
    for _ in range(50):
        flow = [[let[i][j] * asked[i][j] for j in range(n)] for i in range(n)]
        came = [sum(flow[i][j] for i in range(n)) for j in range(n)]
        over = [held[j] + came[j] - sum(flow[j]) - most for j in range(n)]
        if all(o < 1 or not c for o, c in zip(over, came)):
            break
        for j in range(n):
            if over[j] > 0 and came[j]:
                for i in range(n):
                    let[i][j] *= max(0.0, 1 - over[j] / came[j])
    return let


def _propagate(work: Workspace, blocks: DataFrame, n_shards: int, share: int, rounds: int) -> DataFrame:
    """blocks: g, s0, n. Gives g, s0, n, cur."""
    state = work.write(blocks.withColumn("cur", F.col("s0")), "blocks")
    for k in range(rounds):
        around = state.groupBy("g", "cur").agg(F.sum("n").alias("m"))
        # at most an entry for each shard
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), F.xxhash64("g", "cur").alias("tie"), "cur")))
        homes = F.slice(F.transform(ranked, lambda x: x["cur"]), 1, F.ceil(F.sum("m") / share).cast("int"))
        homes = around.groupBy("g").agg(homes.alias("homes"), F.count("*").alias("in")).where("in > size(homes)").drop("in")
        asks = state.join(homes, "g").where(~F.array_contains("homes", F.col("cur")))
        turn = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("g", "s0", F.lit(k)), "s0"))  # of at most a block for each shard
        asks = work.write(asks.withColumn("to", F.element_at("homes", 1 + turn % F.size("homes"))).drop("homes"), "asks")
        asked = [[0] * n_shards for _ in range(n_shards)]
        for r in asks.groupBy("cur", "to").agg(F.sum("n").alias("n")).collect():  # a row for each pair of shards
            asked[r["cur"]][r["to"]] = r["n"]
        if not any(map(any, asked)):
            break
        held = [0] * n_shards
        for r in state.groupBy("cur").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            held[r["cur"]] = r["n"]
        let = F.element_at(_list([x for row in quotas(held, asked, FULL * share) for x in row], "double"), F.col("cur") * n_shards + F.col("to") + 1)
        moves = asks.where(_bucket("g", "s0", F.lit(-1 - k), n=1 << 20) < let * (1 << 20)).select("g", "s0", "to")
        moved = state.join(moves, ["g", "s0"], "left").select("g", "s0", "n", F.coalesce("to", "cur").alias("cur"))
        before, state = state, work.write(moved, "blocks")
        work.drop(before, asks)
    return state


class _Places:
    """The places that are left, in a row: those of the shard with the most first."""

    def __init__(self, free: list[int]):
        self.spans, at = [], 0
        for s in sorted(range(len(free)), key=lambda s: -free[s]):
            if free[s]:
                self.spans.append({"at": at, "s": s})
                at += free[s]

    def shard(self, k: Column) -> Column:
        spans = F.from_json(F.lit(json.dumps(self.spans)), "array<struct<at: long, s: int>>")
        return F.array_max(F.filter(spans, lambda x: x["at"] <= k))["s"]


def shard(df: DataFrame, n_shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    work, text = Workspace(df.sparkSession), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"), F.monotonically_increasing_id().alias("key"))
    start = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("doc_id"))
    base = work.write(rows.withColumn("s0", F.pmod(start, F.lit(n_shards)).cast("int")), "base")
    total = base.count()
    all_, each = _buckets(total), _buckets(total // n_shards)  # for rows in one line, and for those of each shard
    share = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    blocks = base.groupBy("g", "s0").agg(F.count("*").alias("n"))
    linked = blocks.withColumn("all", F.sum("n").over(Window.partitionBy("g"))).where(F.col("all") > 1).drop("all")
    state = _propagate(work, linked, n_shards, max(share + [1]), rounds)

    power = lambda n: -F.floor(F.log2(n)).cast("int")
    units = state.groupBy("g", "cur").agg(F.sum("n").alias("n")).withColumn("key", F.xxhash64("g", "cur")).withColumn("p", power(F.col("n")))
    units = _before(units, ["cur"], ["p"], F.col("n"), each)
    room = _of(share, F.col("cur"))
    fits = F.when(F.col("before") + F.col("n") <= room, F.col("n")).when(F.col("before") == 0, room).otherwise(F.lit(0))
    units = work.write(units.select("g", "cur", "n", "key", fits.cast("long").alias("stay")), "units")
    free = list(share)
    for r in units.groupBy("cur").agg(F.sum("stay").alias("n")).collect():  # a row for each shard
        free[r["cur"]] -= r["n"]
    places = _Places(free)
    over = units.where("stay < n").withColumn("p", power(F.col("n") - F.col("stay")))
    over = _before(over, [], ["p"], F.col("n") - F.col("stay"), all_)
    first, last = places.shard(F.col("before")), places.shard(F.col("before") + F.col("n") - F.col("stay") - 1)
    over = over.select("g", "cur", "before", F.when((F.col("stay") == 0) & (first == last), first).alias("to"))
    over = work.write(over, "over")
    n_over = total and (units.agg(F.sum(F.col("n") - F.col("stay")).alias("n")).first()["n"] or 0)

    known = units.join(over, ["g", "cur"], "left").select("g", "cur", "stay", "before", F.when(F.col("before").isNull(), F.col("cur")).otherwise(F.col("to")).alias("shard"))
    decided = state.select("g", "s0", "cur").join(known, ["g", "cur"])
    rows = work.write(base.join(decided, ["g", "s0"], "left").drop("s0"), "rows")
    plain = rows.where("shard IS NOT NULL").select("doc_id", "size", "text_crc32", "key", "shard")
    # units that are divided, at most two for each shard
    parts = _before(rows.where("cur IS NOT NULL AND shard IS NULL").withColumnRenamed("before", "at"), ["g", "cur"], [], F.lit(1).cast("long"), each)
    parts = parts.withColumn("shard", F.when(F.col("before") < F.col("stay"), F.col("cur")).otherwise(places.shard(F.col("at") + F.col("before") - F.col("stay"))))
    alone = _before(rows.where("cur IS NULL").drop("before"), [], [], F.lit(1).cast("long"), all_)
    alone = alone.withColumn("shard", places.shard(F.col("before") + F.lit(n_over)))
    every = work.write(plain.unionByName(parts.select(plain.columns)).unionByName(alone.select(plain.columns)), "every")
    out = _before(every, ["shard"], [], F.lit(1).cast("long"), each)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
