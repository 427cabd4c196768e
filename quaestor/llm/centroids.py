"""Centroid clustering with block-norm screening.

Components become integers floor(scale * x). A vector is compressed once to codes of BITS bits, a step, its square, and
for each segment of SEGMENT components the norm of what the codes lose. Its inner product with a centroid is that of
the codes and a rest, which by Cauchy and Schwarz is at most the sum over segments of the norms of rest and centroid.
That gives a lower bound of the squared distance without the vector itself. The exact integer distance to the centroid
of the least bound is an upper bound, and only centroids whose lower bound doesn't pass it receive exact integer
distances (about a tenth of them on unclustered vectors). A margin above the rounding of the bounds keeps every
centroid that could be nearest or tie.

Each round's partial sums meet by centroid and component, so that a round brings `k` centroids to the driver and no
vector. Integers and compressed vectors are written once to the shared folder and read in each round.

Vectors that are null, of another length, or hold null or non-finite components take no part. Rows repeat freely: each
is clustered and counted. Rows without an id are clustered, and seed only where rows with ids are fewer than `k`; of
equal ids the least vector seeds first. Fewer vectors than `k` give as many centroids, and no vector gives no row. Ties
go to the smaller centroid, and an empty centroid stays. Components of 2**27 / scale or more fail the job with a
message: their squared distances don't fit in a long. Sums that pass a long are null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import Workspace
from . import held

SEGMENT, BITS, LARGEST = 8, 4, 1 << 27
ROWS = 4096  # rows whose bounds are held at once


class Compressed(NamedTuple):
    """What is kept of integer vectors for lower bounds."""

    codes: np.ndarray  # (n, dimensions), small integers
    step: np.ndarray  # (n,): codes times step is near the vector
    lost: np.ndarray  # (n, segments): norms of what is between them
    square: np.ndarray  # (n,)

    def rows(self, a: int, b: int) -> Compressed:
        return Compressed(*(x[a:b] for x in self))


def segment_norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.reshape(len(vectors), -1, SEGMENT) ** 2).sum(2))


def compress(vectors: np.ndarray) -> Compressed:
    v = vectors.astype(np.float64)
    step = np.maximum(np.abs(v).max(1, initial=0) / ((1 << (BITS - 1)) - 1), 1e-9)
    codes = np.rint(v / step[:, None])
    return Compressed(codes.astype(np.int8), step, segment_norms(v - codes * step[:, None]), np.einsum("nd,nd->n", v, v))


def lower_bounds(small: Compressed, centroids: np.ndarray) -> np.ndarray:
    """Of squared distances to centroids, less a margin for rounding."""
    c = centroids.astype(np.float64)
    near = small.step[:, None] * (small.codes.astype(np.float64) @ c.T)
    squares = small.square[:, None] + np.einsum("kd,kd->k", c, c)[None, :]
    return squares * (1 - 1e-9) - 2 * near - 2 * (small.lost @ segment_norms(c).T) - 1


def exact(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of integer vectors."""
    gap = vectors - centroids
    return np.einsum("nd,nd->n", gap, gap)


def nearest(vectors: np.ndarray, small: Compressed, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (the smaller of equals), its squared distance, and how many distances were worked out."""
    n = len(vectors)
    best, distance, asked = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), 0
    for a in range(0, n, ROWS):
        v = vectors[a : a + ROWS]
        low = lower_bounds(small.rows(a, a + ROWS), centroids)
        first = low.argmin(1)
        least = exact(v, centroids[first])
        row, to = np.nonzero(low <= least[:, None])
        d = exact(v[row], centroids[to])
        order = np.lexsort((to, d, row))
        row, to, d = row[order], to[order], d[order]
        head = np.append(True, row[1:] != row[:-1])  # the bound of `first` is below its distance, so each row has one
        best[a : a + ROWS], distance[a : a + ROWS] = to[head], d[head]
        asked += len(v) + len(row)
    return best, distance, asked


def _prepare(df: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, v (integers) and the parts of what compress() gives."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where((F.size("x") == dimensions) & F.forall("x", finite))

    def run(batches):
        for batch in batches:
            x = batch.column(1)
            whole = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
            if len(whole) and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"a component of {LARGEST / scale:g} or more: squared distances would not fit in a long")
            v = whole.astype(np.int64)
            small = compress(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(v), _lists(small.codes), pa.array(small.step), _lists(small.lost), pa.array(small.square)], names=["id", *READ])

    return rows.mapInArrow(held.task(run), "id long, v array<long>, codes array<byte>, step double, lost array<double>, square double")


READ = ("v", *Compressed._fields)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(rows.ravel()))


def _read(batch, dimensions: int) -> tuple[np.ndarray, Compressed]:
    flat = lambda c, d: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    one = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return flat("v", dimensions), Compressed(flat("codes", dimensions), one("step"), flat("lost", dimensions // SEGMENT), one("square"))


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid with vectors: how many there are, and the exact sum of each component."""
    k, d = centroids.shape

    def run(batches):
        total, count = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            v, small = _read(batch, d)
            to, _, _ = nearest(v, small, centroids)
            np.add.at(total, to, v)
            count += np.bincount(to, minlength=k)
        some = np.flatnonzero(count)
        columns = [pa.array(np.repeat(some, d), pa.int32()), pa.array(np.tile(np.arange(d), len(some)), pa.int32()), pa.array(total[some].ravel(), pa.int64()), pa.array(np.repeat(count[some], d), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "at", "total", "n"])

    parts = rows.select(*READ).mapInArrow(held.task(run), "cluster int, at int, total long, n long")
    sums = parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.collect():  # k * dimensions rows
        out.setdefault(r["cluster"], (r["n"], [0] * d))[1][r["at"]] = int(r["total"])
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared) and centroid (the integers of the final one) for each vector that takes part."""
    if dimensions % SEGMENT:
        raise ValueError(f"dimensions must be a multiple of {SEGMENT}")
    work = Workspace(df.sparkSession)
    rows = work.write(_prepare(df, dimensions, scale, id_col, vector_col), "vectors")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(drawn.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in _sums(rows, centroids).items():
            centroids[c] = [t // n for t in total]

    def run(batches):
        for batch in batches:
            v, small = _read(batch, dimensions)
            to, distance, _ = nearest(v, small, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(to), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    if not len(centroids):
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.array().cast("array<long>").alias("centroid"))
    out = work.write(rows.mapInArrow(held.task(run), "vec_id long, cluster int, distance long"), "clusters")
    work.drop(rows)
    named = out.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "centroid")  # k rows


def inertia(clusters: DataFrame) -> DataFrame:
    """What cluster() gives, with cluster_inertia, inertia and centroid_sha256. Sums of each centroid come to the
    driver, one row a centroid, and are broadcast from there."""
    sums = clusters.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.first("centroid").alias("c")).collect()
    total, fits = sum(r["s"] for r in sums), lambda n: int(n) if n < 1 << 63 else None
    facts = [(r["cluster"], fits(r["s"]), fits(total), sha256_of(r["c"])) for r in sums]
    facts = clusters.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sha256_of(centroid) -> str:
    """The digest of a centroid's components as decimal integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def oracle(k: int = 40, rounds: int = 5) -> str:
    """DuckDB SQL for cluster() and inertia() over embeddings: each round is a table of assignments and one of centroids."""
    nearest_sql = """
        SELECT vec_id, rid, v, c.cluster, c.distance FROM kept, LATERAL (
            SELECT cluster, CAST(list_sum(list_transform(list_zip(kept.v, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance
            FROM {0} m ORDER BY distance, cluster LIMIT 1) c"""
    steps = [
        """kept AS (
        SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS (
        SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
        FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))""",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest_sql.format(f'c{r}')})")
        steps.append(f"""s{r} AS (
        SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i)""")
        steps.append(f"""m{r} AS (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.cluster = m{r}.cluster)")
    steps.append(f"final AS MATERIALIZED ({nearest_sql.format(f'c{rounds}')})")
    return "WITH " + ",\n    ".join(steps) + f"""
    SELECT vec_id, final.cluster, distance, CAST(sum(distance) OVER (PARTITION BY final.cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM final JOIN c{rounds} ON final.cluster = c{rounds}.cluster"""
