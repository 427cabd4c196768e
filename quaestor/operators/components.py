"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import Workspace

SEEDS = 4  # orders that rounds take in turn, so that their plans share compiled code


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """edges -> (node, root) for every node of an edge; nodes of one component have one root, which is one of them.

    Each round every node joins the neighbour (or itself) with the least hash, edges between joined nodes vanish
    and the rest shrink to distinct ones. Hashed order keeps rounds few on chains as well as on stars. A round's
    tables are written, so lineage stays short; nulls and loops are ignored.
    """
    work = Workspace(edges.sparkSession)
    live = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    live = work.write(live, "edges")
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = work.write(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "roots")
    rank = lambda c, k: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("v"))
    k = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(rank("b", k)).alias("m")).select("a", F.least(F.col("m"), rank("a", k))["v"].alias("to"))
        to = work.write(to, "to")
        a, b = to.withColumnRenamed("to", "ta"), to.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        shrunk = live.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        moved = roots.join(to.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        old = (live, roots, to)
        live, roots = work.write(shrunk, "edges"), work.write(moved, "roots")
        work.drop(*old)
        k = (k + 1) % SEEDS
    return roots


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component), the component being its smallest node."""
    roots = components(edges, src, dst)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
