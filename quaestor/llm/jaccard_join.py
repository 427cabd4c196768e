"""Near-duplicate join of documents by the Jaccard similarity of their word shingles, exact at any threshold
(but for two shingles of one 64-bit hash).

Documents with equal sets form a class. A class's shingles are ordered by how frequent they are (from a bounded
table of the most frequent ones, which only sets the order) and then by hash. A prefix that is `extra` shingles
longer than the shortest safe one must share 1 + extra shingles with the prefix of any similar class, or more where
the sizes ask for it (must_share). Each class lengthens its prefix by the candidates that its shortest one is
estimated to bring.

First each class is paired with one class of each of its prefix shingles, that with the fewest rarer shingles, which
joins dense groups at a cost in proportion to their members. Then, of shingles whose classes still lie in several
components, pairs across components are counted, and those that share enough are verified. Before a pair is made, its
places in the two orders and bitmaps of the two sets (shingles.bitmap) bound in how many shingles the classes differ;
of a group of near copies that are not similar enough, hardly a pair is left. Every verification compares whole sets.
So no link between components is lost and none within one is looked for twice. A shingle of more than HOT documents is
paired in parts, and then their first classes; one of more than BLOCK classes is dealt out in pairs of blocks.

Null texts and texts without words have an empty set and are linked with nothing. Rows with equal ids are one
document with the links of all its texts. Null ids are linked like others but never name a component. Columns
besides the id and the text are not read; a table without rows gives none.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources.session import Workspace
from . import held
from . import shingles as S

FREQUENT = 1 << 17  # shingles in the table of frequencies, 16 bytes each
LOCAL = 4  # documents of one partition that make a shingle worth counting
COST, MOST_EXTRA = 16, 6  # estimated candidates from which prefixes grow; by how much at most
BLOCK = 2048
HOT = 8192  # documents of a shingle in one part
LARGE = 100_000  # shingles of more than a block whose numbers are broadcast; more are joined

SETS = "doc_id long, k long, full binary, n long, bits binary, token long, docs long"
# part: 0, or from 1 on of a shingle in parts; at: its place in the class's order, the class's size and extra in one
POSTINGS = "token long, part int, at long, k long"
PAIRS = "a long, b long, need int, token long, at long, k long, hub boolean"
LINKS = "a long, b long"


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that is similar enough."""
    return -(-n * percent // 100)


def must_share(n, extra, m, more, percent: int):
    """How many shingles the prefixes of two classes must share, if the classes are similar enough.

    They share 1 + the smaller extra. Also, the prefix that ends first in the order of shingles holds all that the
    other class shares up to there; what is left of its class is the most that can be shared beyond.
    """
    overlap = -(-percent * (n + m) // (100 + percent))
    rest = np.maximum(need(n, percent) - 1 - extra, need(m, percent) - 1 - more)
    return np.maximum(1 + np.minimum(extra, more), overlap - rest)


def may_link(n, pos, m, place, percent: int):
    """Whether two classes that share the shingle at these places of their orders may be similar enough: what comes
    before in one order comes before in the other."""
    return abs(pos - place) + abs((n - pos) - (m - place)) <= S.most_apart(n, m, percent)


def _at(pos, n, extra):
    return pos << 36 | n << 4 | extra


def _parted(at):
    """Place, size and extra."""
    return at >> 36, at >> 4 & (1 << 32) - 1, at & 15


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _batch(schema: str, *cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=names)


def _sets(docs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """A row for each document with a set, and rows for shingles that are frequent in their partition."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def counted():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= LOCAL
            m = int(some.sum())
            return _batch(SETS, *[[None] * m] * 5, _signed(tokens[some]), counts[some].astype(np.int64))

        for batch in batches:
            rows = []
            for doc, got in zip(batch.column(0).to_pylist(), S.sets(batch.column(1), words)):
                if len(got):
                    full, k = S.digest(got, seed)
                    rows.append((doc, k, full, len(got), S.bitmap(got, percent)))
                    held.append(got)
                    size += len(got)
                    if size > 2_000_000:
                        yield counted()
                        held, size = [], 0
            if rows:
                none = [None] * len(rows)
                yield _batch(SETS, *zip(*rows), none, none)
        if held:
            yield counted()

    return docs.mapInArrow(held.task(run), SETS)


def prefix(tokens: np.ndarray, percent: int, ranked: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix of a set, how frequent its shingles are, and by how many it passes the shortest safe one."""
    at = np.searchsorted(ranked, tokens)
    at[at == len(ranked)] = 0
    often = np.where(ranked[at] == tokens, docs[at], 0) if len(ranked) else np.zeros(len(tokens), dtype=np.int64)
    order = np.lexsort((tokens, often))
    least, floor = need(len(tokens), percent), len(tokens) - need(len(tokens), percent) + 1
    cost = int(often[order[:floor]].sum())
    extra = min(MOST_EXTRA, math.ceil(math.log2(cost / COST)), least - 1) if cost > COST else 0
    head = order[: floor + extra]
    return tokens[head], often[head], extra


def _postings(docs: DataFrame, words: int, percent: int, seed: int, frequent) -> DataFrame:
    def run(batches):
        ranked, counts = frequent.value
        seen: set[int] = set()
        for batch in batches:
            cols: list[list[np.ndarray]] = []
            for got in S.sets(batch.column(1), words):
                if not len(got):
                    continue
                name = S.digest(got, seed)[1]
                if name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                head, often, more = prefix(got, percent, ranked, counts)
                m = len(head)
                parts = 1 + often // HOT
                part = np.where(parts > 1, 1 + name % parts, 0).astype(np.int32)
                cols.append([_signed(head), part, _at(np.arange(m, dtype=np.int64), len(got), more), np.full(m, name, dtype=np.int64)])
            if cols:
                yield _batch(POSTINGS, *map(np.concatenate, zip(*cols)))

    return docs.mapInArrow(held.task(run), POSTINGS)


def fits(n, m, percent: int):
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _first_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs with the first class of each shingle's part; the postings of shingles with several classes; and, of
    shingles in several parts, all postings, the parts' first ones marked as hubs."""

    def run(batches):
        last = None  # the last row, its part's first one, and whether that was shown
        for batch in batches:
            token, part, _, k = cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            m = batch.num_rows
            if not m:
                continue
            turn = np.ones(m, dtype=bool)
            turn[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            again = np.zeros(m, dtype=bool)
            again[1:] = ~turn[1:] & (k[1:] == k[:-1])
            goes_on = last is not None and last[0][0] == token[0] and last[0][1] == part[0]
            if goes_on:
                turn[0], again[0] = False, last[0][3] == k[0]
            at = np.flatnonzero(turn)
            heads = [np.concatenate([[v], c[at]]) for v, c in zip(last[1], cols)] if goes_on else [c[at] for c in cols]
            which = np.cumsum(turn) - (0 if goes_on else 1)
            other = ~turn & ~again
            split = heads[1] > 0
            shown = split | (np.bincount(which[other], minlength=len(heads[0])) > 0)
            if goes_on and last[2]:  # shown before
                shown[0] = False
            both = [np.concatenate([h[shown], c[other]]) for h, c in zip(heads, cols)]
            size, n_hubs = len(both[0]), int(shown.sum())
            if size:
                none = [None] * size
                yield _batch(PAIRS, none, none, none, both[0], both[2], both[3], (np.arange(size) < n_hubs) & (both[1] > 0))
            x, y = [h[which[other]] for h in heads], [c[other] for c in cols]
            (p, n, e), (q, o, f) = _parted(x[2]), _parted(y[2])
            near = fits(n, o, percent) & may_link(n, p, o, q, percent)
            if near.any():
                none = [None] * int(near.sum())
                a, b = np.minimum(x[3], y[3])[near], np.maximum(x[3], y[3])[near]
                yield _batch(PAIRS, a, b, must_share(n, e, o, f, percent)[near].astype(np.int32), *[none] * 4)
            seen = bool(shown[-1]) or bool(goes_on and last[2] and len(heads[0]) == 1)
            last = [c[-1] for c in cols], [h[-1] for h in heads], seen

    return postings.repartition("token", "part").sortWithinPartitions("token", "part", "at", "k").mapInArrow(held.task(run), PAIRS)


def _near(rows: list[tuple], percent: int, across: bool) -> list[tuple]:
    """(a, b, need) of a shingle's rows (at, k, comp, own, bits), in the order of their sizes, that lie in several
    components and may be similar enough; `across`: of two blocks only."""
    if len(rows) <= 6:
        out = []
        for x, (at, k, comp, own, bits) in enumerate(rows):
            p, n, e = _parted(at)
            for place, j, other, block, more in rows[:x]:
                q, m, f = _parted(place)
                if comp == other or k == j or across and own == block or 100 * m < percent * n or not may_link(n, p, m, q, percent):
                    continue
                w = 8 * min(len(bits), len(more))
                differ = (int.from_bytes(S.narrowed(bits, w)) ^ int.from_bytes(S.narrowed(more, w))).bit_count()
                if differ <= S.most_apart(n, m, percent):
                    out.append((min(k, j), max(k, j), int(must_share(n, e, m, f, percent))))
        return out
    at, k, comp, own = (np.array(c) for c in list(zip(*rows))[:4])
    pos, n, extra = _parted(at)
    low, bits, out = np.searchsorted(n, -(-n * percent // 100)), S.Bitmaps([r[4] for r in rows]), []
    for x in range(1, len(rows)):
        ys = np.arange(low[x], x)
        ok = (comp[ys] != comp[x]) & (k[ys] != k[x]) & may_link(n[x], pos[x], n[ys], pos[ys], percent)
        if across:
            ok &= own[ys] != own[x]
        ys = ys[ok]
        if len(ys):
            ys = ys[bits.differ(x, ys) <= S.most_apart(n[x], n[ys], percent)]
            out += zip(np.minimum(k[x], k[ys]).tolist(), np.maximum(k[x], k[ys]).tolist(), must_share(n[x], extra[x], n[ys], extra[ys], percent).tolist())
    return out


def _all_pairs(live: DataFrame, several: DataFrame, percent: int) -> DataFrame:
    """live: token, at, k, comp, bits; several: token and m, its classes, if they lie in several components.

    A shingle's classes come in order of size, and a class meets those before it that are not too small. A group
    with blocks (i, j) pairs block i with block j only. A sieve keeps most rows of other shingles from the shuffle;
    those that it lets through lie in one component each and make no pair.
    """
    sc = live.sparkSession.sparkContext
    sieve = sc.broadcast(S.Sieve(several.select((F.xxhash64("token").bitwiseAND(F.lit((1 << 63) - 1))).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def chosen(h: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.has(h))

    large = several.where(F.col("m") > BLOCK)
    large = F.broadcast(large) if len(large.take(LARGE + 1)) <= LARGE else large
    dealt = live.where(chosen.asNondeterministic()(F.xxhash64("token").bitwiseAND(F.lit((1 << 63) - 1)))).join(large, "token", "left")
    dealt = dealt.withColumn("blocks", F.ceil(F.coalesce("m", F.lit(1)) / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "at", "k", "comp", "own", "bits")

    def run(batches):
        out: list[tuple] = []
        for (_, i, j), group in groupby(_rows(batches), key=lambda r: r[:3]):
            rows = [r[3:] for r in group]  # at most two blocks
            if len(rows) > 1:
                out += _near(rows, percent, i != j)
            if len(out) > 50_000:
                yield _batch("a long, b long, need int", *zip(*out))
                out = []
        if out:
            yield _batch("a long, b long, need int", *zip(*out))

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", F.shiftright("at", 4).bitwiseAND(F.lit((1 << 32) - 1)), "k").mapInArrow(held.task(run), "a long, b long, need int")


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared, len(both) - shared


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int, seed: int, work: Workspace) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(classes.select("k", "rep"), "k")
    key = lambda c: F.xxhash64(F.coalesce(c, F.lit(-1))).bitwiseAND(F.lit((1 << 63) - 1))
    sieve = docs.sparkSession.sparkContext.broadcast(S.Sieve(wanted.select(key("rep").alias("h")), "h"))
    keyed = docs.select("text", key("doc_id").alias("h"))

    def run(batches):
        chosen, seen = sieve.value, set()
        for batch in batches:
            texts = batch.column(0).filter(pa.array(chosen.has(batch.column(1))))
            for s in range(0, len(texts), 500):
                sets = {S.digest(g, seed)[1]: g.tobytes() for g in S.sets(texts.slice(s, 500), words) if len(g)}
                new = [k for k in sets if k not in seen]
                seen.update(new)
                yield _batch("k long, items binary", new, [sets[k] for k in new])

    # a set may come from several partitions, and a few come that weren't asked for
    sets = work.write(keyed.mapInArrow(held.task(run), "k long, items binary").dropDuplicates(["k"]), "sets")
    joined = pairs.select("a", "b").join(sets.select(F.col("k").alias("b"), F.col("items").alias("y")), "b").join(sets.select(F.col("k").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")

    def check(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            ok = []
            for p, q in zip(x, y):
                shared, union = similarity(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64))
                ok.append(100 * shared >= percent * union)
            ok = pa.array(ok, pa.bool_())
            yield _batch(LINKS, a.filter(ok), b.filter(ok))

    out = work.write(joined.mapInArrow(check, LINKS).distinct(), "links")
    work.drop(sets)
    return out


def join(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, n_shingles, component_id, verified_links (of its class; links inside a known component are not looked for) for each row."""
    held.bounded(df.sparkSession)
    spark = df.sparkSession
    work, sc = Workspace(spark), spark.sparkContext
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    while True:
        base = work.write(_sets(docs, words, percent, seed), "base")
        rows = base.where("k IS NOT NULL").select("doc_id", "k", "full", "n", "bits")
        classes = work.write(rows.groupBy("k").agg(F.min("doc_id").alias("rep"), F.min("full").alias("x"), F.max("full").alias("y"), F.min("bits").alias("bits")), "classes")
        if classes.where("x <> y").isEmpty():
            break
        work.drop(base, classes)
        seed += 1  # two sets had one name
    top = base.where("token IS NOT NULL").groupBy("token").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "token").limit(FREQUENT)
    table = np.array(sorted(map(tuple, top.collect())), dtype=np.int64).reshape(-1, 2)  # at most FREQUENT rows
    ranked = table[:, 0].view(np.uint64) if len(table) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(ranked)
    frequent = sc.broadcast((ranked[order], table[order, 1] if len(table) else np.zeros(0, dtype=np.int64)))
    first = work.write(_first_pairs(_postings(docs, words, percent, seed, frequent), percent), "first")
    hubs = first.where("hub").select("token", F.lit(0).alias("part"), "at", "k")
    pairs = first.unionByName(_first_pairs(hubs, percent)).where("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need"))
    # a class may share some of its shingles with another first class, so half of the number is asked for here
    pairs = work.write(pairs.where("2 * c >= need").select("a", "b"), "pairs")
    links = _verified(docs, classes, pairs, words, percent, seed, work)
    comp = components(links, "a", "b").select(F.col("node").alias("k"), F.col("root").alias("comp"))
    named = classes.select("k", "bits").join(comp, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    live = work.write(first.where("token IS NOT NULL").select("token", "at", "k").join(named, "k"), "live")
    several = live.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y").select("token", "m")
    several = work.write(several, "several")
    rest = _all_pairs(live, several, percent).groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")
    rest = work.write(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    work.drop(first, live, several)
    links = links.unionByName(_verified(docs, classes, rest, words, percent, seed, work))
    roots = components(links, "a", "b").select(F.col("node").alias("k"), "root")
    # rows with one id are one document: their classes are linked through it
    shared = rows.groupBy("doc_id").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("doc_id IS NOT NULL AND a <> b")
    if not shared.isEmpty():
        same = rows.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("k").alias("b"))
        roots = components(links.unionByName(same), "a", "b").select(F.col("node").alias("k"), "root")
    named = classes.select("k", "rep").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("links"))
    by_class = work.write(named.join(least, "root").join(degree, "k", "left").select("k", "component_id", F.coalesce("links", F.lit(0)).alias("verified_links")), "by_class")
    linked = rows.join(by_class, "k").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "verified_links")
    bare = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\f\r", "")) == 0
    alone = docs.where(bare).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("verified_links"))
    return linked.unionByName(alone)


def deduplicate(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each component: the rows of its least id. Rows without an id stay."""
    spark = df.sparkSession
    found = join(df, words, percent, id_col, text_col)
    gone = Workspace(spark).write(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    key = lambda c: F.xxhash64(F.lit(3), c).bitwiseAND(F.lit((1 << 63) - 1))
    sieve = spark.sparkContext.broadcast(S.Sieve(gone.select(key("doc_id").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def chosen(h: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.has(h))

    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"))
    # only rows that the sieve holds are shuffled for the exact answer
    sifted = packed.withColumn("in", chosen.asNondeterministic()(key(F.coalesce("id", F.lit(0)))))
    left = sifted.where("in").join(gone.withColumnRenamed("doc_id", "id"), "id", "left_anti")
    return sifted.where(~F.col("in")).select("row.*").unionByName(left.select("row.*"))
