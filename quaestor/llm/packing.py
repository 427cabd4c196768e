"""Packing by minimum bin slack.

Documents become token ids (with an end id each). What fills whole windows is cut off; the remaining lengths are
kept as a multiset. A window takes the longest remaining length and then the multiset that fills it closest to its
capacity, found by a subset-sum over a bitset and traced back to counts. Where that leaves a slack, the first part of
another remaining document closes it, and the rest of that document waits on. The scan's own partitions pack their own
documents, so nothing is shuffled; a partition holds one pool of documents at a time, and once half of a full pool is
packed, windows with a slack wait for the next one. Only the last window of a partition can stay short: it is cut at
powers of two, so that no window is padded there. `kind` says how a piece came about: whole (a window of one document),
fit (by bin slack), cut (closes a slack), tail (of a partition's last, short window).

Null and empty texts hold the end id alone. Rows repeat freely: each row is a document of its own. Columns besides
the id and the text are not read. A table without rows gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from . import held, tokens

CAPACITY = 2048
POOL = 4000  # remaining documents of a pool
SLICE = 1_000_000  # bytes of text that are encoded at once, which bounds what a worker holds meanwhile

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, kind string"


def fill(lengths: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length together come closest to the capacity without passing it.

    Bit s of `reach` says that s tokens can be had. Lengths go in from the longest, in binary parts of their
    counts; a snapshot before each part lets the sum be traced back. The search ends once the capacity is met.
    """
    reach, goal, steps = 1, 1 << capacity, []
    mask = (goal << 1) - 1
    for n in sorted((n for n in lengths if n <= capacity), reverse=True):
        left, part = min(lengths[n], capacity // n), 1
        while left and not reach & goal:
            take = min(part, left)
            steps.append((reach, n, take))
            reach |= (reach << n * take) & mask
            left, part = left - take, part * 2
        if reach & goal:
            break
    total, counts = reach.bit_length() - 1, defaultdict(int)
    for before, n, take in reversed(steps):
        if not before >> total & 1:
            total -= n * take
            counts[n] += take
    return dict(counts)


def window(lengths: dict[int, int], capacity: int) -> list[int]:
    """The next window's lengths, taken out of the pool: the longest, and those that leave the least slack beside it."""

    def take(n: int, count: int) -> None:
        lengths[n] -= count
        if not lengths[n]:
            del lengths[n]

    longest = max(lengths)
    take(longest, 1)
    counts = fill(lengths, capacity - longest)
    for n, c in counts.items():
        take(n, c)
    return [longest, *(n for n, c in counts.items() for _ in range(c))]


def powers(n: int, capacity: int) -> list[int]:
    """Window sizes for n tokens in a row: whole windows, then falling powers of two."""
    return [capacity] * (n // capacity) + [1 << b for b in reversed(range((n % capacity).bit_length())) if n % capacity >> b & 1]


class Packer:
    """Packs the documents of one partition; pieces() gives what is settled."""

    def __init__(self, first_sequence: int, capacity: int, pool: int):
        self.next, self.capacity, self.pool = first_sequence, capacity, pool
        self.waiting: dict[int, list] = defaultdict(list)
        self.n_waiting = 0
        self.out: list[tuple] = []

    def _piece(self, doc, start: int, ids: memoryview, sequence: int, offset: int, doc_tokens: int, kind: str) -> None:
        self.out.append((doc, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence, offset, kind))

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _wait(self, doc, start: int, ids, total: int) -> None:
        self.waiting[len(ids) // 4].append((doc, start, ids, total))
        self.n_waiting += 1

    def _taken(self, n: int) -> tuple:
        out = self.waiting[n].pop()
        if not self.waiting[n]:
            del self.waiting[n]
        self.n_waiting -= 1
        return out

    def add(self, doc, ids: bytes) -> None:
        total, step, view = len(ids) // 4, self.capacity * 4, memoryview(ids)
        whole = total // self.capacity
        for i in range(whole):
            self._piece(doc, i * self.capacity, view[i * step : (i + 1) * step], self._sequence(), 0, total, "whole")
        if total % self.capacity:
            self._wait(doc, whole * self.capacity, bytes(view[whole * step :]), total)
            if self.n_waiting >= self.pool:
                self.settle(last=False)

    def settle(self, last: bool) -> None:
        """Packs all that waits; unless last, until half of a pool is left and the next window would have a slack."""
        while self.waiting:
            lengths = {n: len(x) for n, x in self.waiting.items()}
            while lengths:
                chosen = window(lengths, self.capacity)
                slack = self.capacity - sum(chosen)
                if slack and not last and 2 * self.n_waiting <= self.pool:
                    return
                if slack and not lengths:
                    return self._tail(chosen) if last else None
                sequence, offset = self._sequence(), 0
                for n in chosen:
                    doc, start, ids, total = self._taken(n)
                    self._piece(doc, start, memoryview(ids), sequence, offset, total, "fit")
                    offset += n
                if slack:  # every length left is longer, or it would have gone in
                    doc, start, ids, total = self._taken(min(lengths))
                    self._piece(doc, start, memoryview(ids)[: 4 * slack], sequence, offset, total, "cut")
                    self._wait(doc, start + slack, bytes(ids[4 * slack :]), total)
                    break

    def _tail(self, chosen: list[int]) -> None:
        """The last window, end to end in windows of falling powers of two."""
        sizes = iter(powers(sum(chosen), self.capacity))
        room = offset = sequence = 0
        for n in chosen:
            doc, start, ids, total = self._taken(n)
            at = 0
            while at < n:
                if not room:
                    room, offset, sequence = next(sizes), 0, self._sequence()
                take = min(room, n - at)
                self._piece(doc, start + at, memoryview(ids)[at * 4 : (at + take) * 4], sequence, offset, total, "tail")
                at, room, offset = at + take, room - take, offset + take

    def pieces(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in SCHEMA.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)


def _packed(batches, packer: Packer, tokenizer: str, end: bytes):
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in tokens.slices(texts, SLICE):
            for doc, got in zip(ids[a:b], tokens.encode_texts(tokenizer, [t or "" for t in texts.slice(a, b - a).to_pylist()])):
                packer.add(doc, got + end)
            if len(packer.out) > 20_000:
                yield _batch(packer.pieces())
    packer.settle(last=True)
    yield _batch(packer.pieces())


def pack(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a window of at most `capacity` tokens."""
    held.bounded(df.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        yield from _packed(batches, Packer(TaskContext.get().partitionId() << 36, capacity, pool), tokenizer, end)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(held.task(run), SCHEMA)
