"""Nearest neighbours by inner product from low-dimensional stable projections in a kd-tree.

Vectors get one more component, so that the largest inner product is the least distance: sqrt(M^2 - |x|^2), M being
the greatest norm, and 0 for queries. PROJECTED Gaussian sums keep distances: the square of a projected distance
over that of the true one is chi-square with PROJECTED degrees of freedom.

The tree's upper part splits all rows into blocks of about BLOCK rows, by medians of the projections of about SAMPLE
distinct rows (the only thing that is fitted on a sample; every row is in a block, and a block of more than twice BLOCK
rows, as many equal vectors make, is dealt into several with one box). Its lower part is a tree in each block. A query asks the
blocks in the order of their boxes' projected distances, in rounds of ever more blocks, and takes its k-th best score so far
along; in a block it takes the leaves in the same order and verifies the vectors in them by whole inner products. It
stops, in a block as between blocks, once a vector nearer than its k-th best would lie beyond the next distance
with probability CERTAIN or more by the chi-square law. A round shuffles the vectors of the blocks that are asked, once for
every ASKED queries of a block; a task holds one block and streams its queries. The driver holds a box for each block.

Vectors that are null, all zeros, of another length than most, or hold null or non-finite components take no part.
Rows with equal ids are candidates each, but not for queries of that id, which is asked once, by its least vector. Columns besides
the id and the vector are not read; a table without rows gives none. Equal scores go by the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import Workspace
from . import held

PROJECTED, CERTAIN, LEAF, SEED = 6, 0.7, 64, 7
BLOCK, SAMPLE, ASKED = 16_384, 65_536, 1 << 17

OUT = "query_id long, vec_id long, score double"
PLACED = "id long, v array<double>, p array<double>, b int"
ASKS = "b int, id long, v array<double>, kth double"


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """The distribution function for an even number of degrees: 1 - exp(-x/2) * sum of (x/2)^j / j!."""
    h = np.minimum(np.asarray(x, dtype=np.float64), 1400.0) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for j in range(1, degrees // 2):
        term = term * h / j
        total = total + term
    return 1 - np.exp(-h) * total


class Tree:
    """A kd-tree as its leaves: index arrays and boxes. A node splits at the median of its widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves, todo = [], [np.arange(len(points))]
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                self.leaves.append(at)
                continue
            own = points[at]
            side = int(np.argmax(own.max(0) - own.min(0)))
            half = np.argpartition(own[:, side], len(at) // 2)
            todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
        self.low = np.array([points[at].min(0) for at in self.leaves])
        self.high = np.array([points[at].max(0) for at in self.leaves])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for d in range(queries.shape[1]):
            q = queries[:, d : d + 1]
            out += np.maximum(np.maximum(self.low[None, :, d] - q, q - self.high[None, :, d]), 0) ** 2
        return out


def gauss(d: int) -> np.ndarray:
    """The projection of vectors of d components and the one more."""
    return np.random.default_rng(SEED).normal(size=(d + 1, PROJECTED))


def stops(distance: np.ndarray, true: np.ndarray, certain: float) -> np.ndarray:
    """Whether vectors within the true squared distance lie beyond the projected one surely enough to stop."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.isfinite(true) & (chi_square(distance / np.maximum(true, 1e-300), PROJECTED) >= certain)


class Block:
    """Rows of one block with the tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, leaf: int = LEAF):
        self.ids, self.vectors, self.norm = ids, vectors, norm
        self.gauss = gauss(vectors.shape[1])
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("nd,nd->n", vectors, vectors), 0))
        self.tree = Tree(vectors @ self.gauss[:-1] + rest[:, None] * self.gauss[-1], leaf)

    def search(self, query_ids, queries, floor, k: int, certain: float = CERTAIN):
        """(query's place, vec_id, score) of each query's k best that reach its floor; and how many pairs were verified."""
        q = len(queries)
        near = self.tree.distances(queries @ self.gauss[:-1])
        order = np.argsort(near, axis=1, kind="stable")
        q_norm = np.einsum("qd,qd->q", queries, queries) + self.norm * self.norm
        best = np.full((q, k), -np.inf)
        best_id = np.full((q, k), np.iinfo(np.int64).max)
        active, seen = np.arange(q), 0
        for step in range(len(self.tree.leaves)):
            kth = np.maximum(best[active, k - 1], floor[active])
            active = active[~stops(near[active, order[active, step]], q_norm[active] - 2 * kth, certain)]
            if not len(active):
                break
            leaves = order[active, step]
            by = np.argsort(leaves, kind="stable")
            bounds = np.flatnonzero(np.diff(leaves[by])) + 1
            for rows in np.split(active[by], bounds):
                at = self.tree.leaves[order[rows[0], step]]
                # einsum adds in one order for every pair, so that equal vectors have equal scores
                scores = np.einsum("qd,nd->qn", queries[rows], self.vectors[at])
                scores[query_ids[rows][:, None] == self.ids[at][None, :]] = -np.inf
                seen += scores.size
                better = scores.max(1) >= np.maximum(best[rows, k - 1], floor[rows])
                rows, scores = rows[better], scores[better]
                if not len(rows):
                    continue
                all_s = np.hstack([best[rows], scores])
                all_i = np.hstack([best_id[rows], np.broadcast_to(self.ids[at], scores.shape)])
                top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                best[rows], best_id[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
        ok = np.isfinite(best) & (best >= floor[:, None])
        place = np.broadcast_to(np.arange(q)[:, None], best.shape)[ok]
        return place, best_id[ok], best[ok], seen


class Splits:
    """The upper part of the tree: for each inner node, level by level, the side it splits and where."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, self.sides, self.cuts = levels, [], []
        nodes = [sample]
        for _ in range(levels):
            below = []
            for own in nodes:
                side = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
                cut = float(np.median(own[:, side])) if len(own) else 0.0
                self.sides.append(side)
                self.cuts.append(cut)
                below += [own[own[:, side] <= cut], own[own[:, side] > cut]]
            nodes = below

    def blocks(self, points: np.ndarray) -> np.ndarray:
        node, sides, cuts = np.zeros(len(points), np.int64), np.array(self.sides, np.int64), np.array(self.cuts)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), sides[node]] > cuts[node])
        return (node - (1 << self.levels) + 1).astype(np.int32)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(rows, dtype=np.float64).ravel())


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def placed(rows: DataFrame, norm: float, splits: Splits | None, asked: bool = False) -> DataFrame:
    """Rows with their projections and their blocks; queries have 0 for the component that the others get."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1))
                g = gauss(v.shape[1])
                p = v @ g[:-1]
                if not asked:
                    p = p + np.sqrt(np.maximum(norm * norm - np.einsum("nd,nd->n", v, v), 0))[:, None] * g[-1]
                b = np.zeros(len(v), np.int32) if splits is None else splits.blocks(p)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(p), pa.array(b)], names=["id", "v", "p", "b"])

    return rows.select("id", "v").mapInArrow(held.task(run), PLACED)


def _index(work: Workspace, rows: DataFrame, n: int, norm: float, block: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """b, id, v of all rows, written; and the boxes of blocks by number."""
    levels = max(0, math.ceil(math.log2(max(1, n) / block)))
    splits = None
    if levels:
        one_in = max(1, n // SAMPLE)
        some = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(one_in)) == 0).select("id", "v").distinct()
        splits = Splits(np.array([r["p"] for r in placed(some, norm, None).select("p").collect()]).reshape(-1, PROJECTED), levels)  # about SAMPLE
    index = work.write(placed(rows, norm, splits), "placed")
    ends = [f(F.col("p")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(PROJECTED)]
    facts = index.groupBy("b").agg(F.count("*").alias("n"), *ends).collect()  # a row a block
    names, boxes = [], []
    for r in sorted(facts, key=lambda r: r["b"]):
        parts = -(-r["n"] // (2 * block))
        names.append((r["b"], len(boxes), parts))
        boxes += [[r[c] for c in r.asDict() if c not in ("b", "n")]] * parts
    known = F.broadcast(rows.sparkSession.createDataFrame(names, "b int, first int, parts int"))
    number = (F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("parts"))).cast("int")
    out = work.write(index.join(known, "b").select(number.alias("b"), "id", "v"), "blocks")
    work.drop(index)
    low_high = np.array(boxes, dtype=np.float64).reshape(-1, 2 * PROJECTED)
    return out, low_high[:, :PROJECTED], low_high[:, PROJECTED:]


def _asks(state: DataFrame, low: np.ndarray, high: np.ndarray, norm: float, first: int, last: int) -> DataFrame:
    """The blocks from first to last, in the order of each query's projected distances, that its k-th best lets it ask."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                v, p, kth = matrix(part.column(1)), matrix(part.column(2)), part.column(3).to_numpy(zero_copy_only=False)
                far = np.zeros((len(v), len(low)))
                for d in range(PROJECTED):
                    q = p[:, d : d + 1]
                    far += np.maximum(np.maximum(low[None, :, d] - q, q - high[None, :, d]), 0) ** 2
                order = np.argsort(far, axis=1, kind="stable")[:, first:last]
                true = np.einsum("qd,qd->q", v, v) + norm * norm - 2 * kth
                go = ~stops(np.take_along_axis(far, order, 1), np.broadcast_to(true[:, None], order.shape), CERTAIN)
                who, which = np.nonzero(go)
                if len(who):
                    cols = [pa.array(order[who, which].astype(np.int32)), part.column(0).take(pa.array(who)), lists(v[who]), pa.array(kth[who])]
                    yield pa.RecordBatch.from_arrays(cols, names=["b", "id", "v", "kth"])

    return state.select("id", "v", "p", "kth").mapInArrow(held.task(run), ASKS)


def _found(index: DataFrame, asks: DataFrame, parts: DataFrame, norm: float, k: int) -> DataFrame:
    """query_id, vec_id, score: for each query and block it asks, the k best there that reach the query's k-th so far."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, ids, rows, block = None, [], [], None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5)]
            turn = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            for a, z in zip(np.append(0, turn), np.append(turn, batch.num_rows)):
                if a == z:
                    continue
                if now != (cols[0][a], cols[1][a]):
                    now, ids, rows, block = (cols[0][a], cols[1][a]), [], [], None
                v = matrix(batch.column(4).slice(a, z - a))
                if cols[2][a] == 0:
                    ids.append(cols[3][a:z])
                    rows.append(v)
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(rows), norm)
                    ids, rows = [], []
                for at in range(0, len(v), 1024):
                    q_ids = cols[3][a:z][at : at + 1024]
                    place, found, score, _ = block.search(q_ids, v[at : at + 1024], cols[4][a:z][at : at + 1024], k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[place]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    data = index.join(F.broadcast(parts), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("kth"))
    dealt = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    asked = asks.join(F.broadcast(parts), "b").select("b", dealt.alias("part"), F.lit(1).alias("kind"), "id", "v", "kth")
    both = data.unionByName(asked).repartition("b", "part").sortWithinPartitions("b", "part", "kind")
    return both.mapInArrow(held.task(run), OUT)


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, their k nearest of all other rows."""
    work, rows = Workspace(df.sparkSession), usable(df, id_col, vector_col)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    norm = math.sqrt(facts["m"] or 0.0)
    index, low, high = _index(work, rows, facts["n"] or 0, norm, block)
    queries = placed(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), norm, None, asked=True)
    queries = work.write(queries.drop("b"), "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = df.sparkSession.createDataFrame([], OUT)
    first, last = 0, 1
    while first < len(low):
        kth = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        state = queries.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        asks = _asks(state, low, high, norm, first, last)
        parts = [(r["b"], -(-r["n"] // ASKED)) for r in asks.groupBy("b").agg(F.count("*").alias("n")).collect()]  # a row a block
        if not parts:
            break
        found = _found(index, asks, df.sparkSession.createDataFrame(parts, "b int, parts int"), norm, k)
        both = best.unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
        old, best = best, work.write(both, "best")
        if first:
            work.drop(old)
        first, last = last, 4 * last + 1
    work.drop(index, queries)
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")
