"""Best-fit packing improved by swap-based local search.

Items of at most `capacity` go into as few bins as can be. A group of items begins with best fit, longest first. While
it has more bins than its total needs, the emptiest bin is dissolved: each of its items is moved to the bin that it
fits best, or exchanged with another bin's item for a shorter one (one for one), with two items of it, or two of its
own for one (two for one). Every such step makes a fuller bin fuller and so the sum of squared fills greater, which
bounds their number. Where nothing can go on, the next bin is tried; passes end when one saves no bin.

Items are dealt into groups of about GROUP by their serial number (of more where they are short, so that a group fills
SHARE times as many bins as it leaves open), and a group is one task's. All groups of a round leave their OPEN emptiest
bins open: the items in those, a SHARE-th part at most, are dealt into the groups of the next round, until one group is
left. So what partial bins there are at the end is those of one group, however many items there are.

pack() makes documents into items: ids of a text with the end id, and only documents longer than the capacity are cut,
into pieces of it; the ids themselves are not shuffled. Null and empty texts hold the end id alone. Rows repeat freely:
each row is a document of its own. Other columns are not read. A table without rows gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.session import Workspace
from . import held, tokens

CAPACITY, GROUP, OPEN, SHARE = 4096, 8_000, 4, 16


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items (by place) of each bin: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = defaultdict(list)  # bins by what is left in them
    levels: list[int] = []  # the keys of free, in order
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(levels, lengths[i])
        if at < len(levels):
            left = levels[at]
            b = free[left].pop()
            if not free[left]:
                del free[left], levels[at]
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := left - lengths[i]:
            if left not in free:
                insort(levels, left)
            free[left].append(b)
    return bins


class Search:
    """Exchanges between the bins of one group."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]]):
        self.lengths, self.capacity = np.array(lengths, dtype=np.int64), capacity
        self.bins = [set(b) for b in bins]
        self.of = np.zeros(len(lengths), dtype=np.int64)
        for b, items in enumerate(bins):
            self.of[items] = b
        self.fill = np.bincount(self.of, self.lengths, len(bins)).astype(np.int64)
        self.steps = 0
        self._two: dict[int, np.ndarray] = {}  # of bins: sums of two items

    def _put(self, items, b: int) -> None:
        for i in items:
            a = int(self.of[i])
            self.bins[a].remove(i)
            self.bins[b].add(i)
            self.fill[a] -= self.lengths[i]
            self.fill[b] += self.lengths[i]
            self.of[i] = b
            self._two.pop(a, None)
        self._two.pop(b, None)

    def _pairs(self, b: int) -> dict[int, tuple[int, int]]:
        """Sums of two items of a bin, with one such pair each; items of one length count twice at most."""
        by: dict[int, list[int]] = defaultdict(list)
        for i in sorted(self.bins[b]):
            if len(by[int(self.lengths[i])]) < 2:
                by[int(self.lengths[i])].append(i)
        some, out = [i for v in by.values() for i in v], {}
        for k, i in enumerate(some):
            for j in some[k + 1 :]:
                out.setdefault(int(self.lengths[i] + self.lengths[j]), (i, j))
        return out

    def _sums(self, b: int) -> np.ndarray:
        if b not in self._two:
            self._two[b] = np.array(list(self._pairs(b)), dtype=np.int64)
        return self._two[b]

    def _step(self, b: int) -> bool:
        """One exchange between bin b and a fuller one, which gets fuller: the one that leaves it least room."""
        room = self.capacity - self.fill
        fuller = (room > 0) & (self.fill >= self.fill[b])
        fuller[b] = False
        others = np.flatnonzero(fuller)
        if not len(others):
            return False

        def best(came: int, given: np.ndarray, place: np.ndarray) -> int | None:
            """Which of `given` to get for `came`, so that its bin is filled best."""
            more = came - given
            more[(more <= 0) | (more > place)] = 0
            at = int(more.argmax()) if len(more) else 0
            return at if len(more) and more[at] else None

        own = sorted({int(self.lengths[i]): i for i in sorted(self.bins[b])}.items(), reverse=True)
        for n, i in own:
            fits = others[room[others] >= n]
            if len(fits):
                self._put([i], int(fits[room[fits].argmin()]))
                return True
        theirs = np.flatnonzero(fuller[self.of])
        lengths, place = self.lengths[theirs], room[self.of[theirs]]
        for n, mine in [*((n, (i,)) for n, i in own), *sorted(self._pairs(b).items(), reverse=True)]:
            if (at := best(n, lengths, place)) is not None:
                j = int(theirs[at])
                self._put(mine, int(self.of[j]))
                self._put([j], b)
                return True
        two = [self._sums(int(a)) for a in others]
        sums, bins = np.concatenate(two), np.repeat(others, [len(x) for x in two])
        for n, i in own:
            if (at := best(n, sums, room[bins])) is not None:
                a = int(bins[at])
                pair = self._pairs(a)[int(sums[at])]
                self._put([i], a)
                self._put(pair, b)
                return True
        return False

    def run(self) -> list[list[int]]:
        """Bins after the search: passes over the bins, the emptiest first, until no more can be saved or a pass
        doesn't save a bin."""
        least, saved = -(-int(self.lengths.sum()) // self.capacity), True
        while saved and (self.fill > 0).sum() > least:
            saved = False
            for b in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[b] < self.capacity and self._step(b):
                    self.steps += 1
                    saved |= not self.fill[b]
                if (self.fill > 0).sum() <= least:
                    break
        return [sorted(b) for b in self.bins if b]


def assign(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items (by place) of each bin, for one group."""
    if not lengths:
        return []
    return Search(lengths, capacity, best_fit(lengths, capacity)).run()


ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, serial long"


def pieces(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents' pieces of at most `capacity` tokens, with a serial number; only longer documents have several."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 36
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in tokens.slices(texts):
                ids, ends = tokens.encode(tokenizer, [t or "" for t in texts.slice(a, b - a).to_pylist()])
                raw, out, at = memoryview(ids.astype("<u4", copy=False).tobytes()), [], 0
                for doc, stop in zip(docs[a:b], ends.tolist()):
                    total = stop - at + 1
                    for k in range(-(-total // capacity)):
                        start, length = k * capacity, min(capacity, total - k * capacity)
                        last = start + length == total
                        crc = zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length - last)])
                        out.append((doc, k, start, length, zlib.crc32(end, crc) if last else crc, serial))
                        serial += 1
                    at = stop
                yield _table(out, ITEM)

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return rows.mapInArrow(held.task(run), ITEM)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kind = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)


def _packer(capacity: int, turn: int, open_bins: int):
    """Packs one group; items of the open bins get no sequence."""

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.drop_columns(["group"]).sort_by("serial")
        lengths = part.column("length").to_numpy()
        bins = assign(lengths.tolist(), capacity)
        left = np.array([capacity - lengths[b].sum() for b in bins])
        kept = {int(b) for b in np.argsort(-left, kind="stable")[:open_bins] if left[b]}
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        for k, b in enumerate(bins):
            sequence[b] = -1 if k in kept else (1 << 62) + (turn << 56) + (key[0].as_py() << 24) + k
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        return part.append_column("sequence_id", pa.array(sequence, mask=sequence < 0)).append_column("offset", pa.array(offset))

    return run


def place(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, open_bins: int = OPEN) -> DataFrame:
    """Items (columns length and serial, which is unique, and others) with sequence_id and offset.

    Full items are sequences by themselves. `items` is read more than once; it should be a written table.
    """
    spark, work = items.sparkSession, Workspace(items.sparkSession)
    schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    full = items.where(F.col("length") >= capacity).select("*", F.col("serial").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    live, done, turn = items.where(F.col("length") < capacity), [full], 0
    while True:
        n, total = live.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(-(-n // group), total // (SHARE * open_bins * capacity)))
        last = groups == 1

        # serials count within partitions, so that groups are even however rows repeat
        dealt = live.withColumn("group", F.pmod(F.xxhash64("serial"), F.lit(groups)).cast("int"))
        out = work.write(dealt.groupBy("group").applyInArrow(_packer(capacity, turn, 0 if last else open_bins), schema), f"turn{turn}")
        done.append(out.where("sequence_id IS NOT NULL"))
        if last:
            break
        live, turn = out.where("sequence_id IS NULL").drop("sequence_id", "offset"), turn + 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of a document."""
    work = Workspace(df.sparkSession)
    return place(work.write(pieces(df, tokenizer, end_id, capacity, **columns), "pieces"), capacity, group).drop("serial")
