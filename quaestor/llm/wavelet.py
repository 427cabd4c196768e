"""Token ids in wavelet matrix files.

A shard's ids lie in one compressed file: for each bit of an id, from the highest, a plane of one bit a token in
the order that the planes above leave (zeros before ones, each in their old order). Planes are cut into blocks, each
compressed alone. A directory beside them holds the ones before each block, and those inside it before each WORD bits;
so an access, a rank or a select opens one block of each plane and counts the ones of WORD bits at most. A table of the
shard's documents and their lengths stands in front.

Shards are rows of a Parquet folder, one to a part file, written and read by Spark; so they lie in any store and a
lost executor's shards are written again. Documents are dealt by ranges of their ids, in ascending order; a shard
ends at a document's end once it has SHARD tokens.

Null and empty texts hold the end id alone. Rows with equal ids follow each other in the order of their texts, null
ids come first; columns besides the id and the text are not read; a table without rows gives a folder without shards.
"""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import Workspace
from . import tokens

SHARD = 1 << 20  # tokens
BLOCK, WORD = 1 << 16, 512  # bits
MAGIC = b"QWM2"

SHARDS = "part int, shard int, n_docs long, n_tokens long, file binary"
READ = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _moved(seq: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Those with a zero, then those with a one."""
    return np.concatenate([seq[np.flatnonzero(~plane)], seq[np.flatnonzero(plane)]])


def _kind(bits: int):
    return np.uint16 if bits <= 16 else np.uint32


def build(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's file. Header: magic, documents, tokens, bits; then sized sections, compressed but for directories."""
    pack = zstandard.ZstdCompressor(level=1).compress
    n, bits = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    null = np.array([d is None for d in doc_ids], dtype=bool)
    sections = [pack(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()), pack(np.packbits(null).tobytes()), pack(np.array(lengths, dtype="<u4").tobytes())]
    kind, n_blocks = _kind(bits), -(-n // BLOCK)
    seq = ids.astype(kind)
    for b in reversed(range(bits)):
        plane = (seq & kind(1 << b)) != 0
        seq = _moved(seq, plane)
        packed = np.zeros(n_blocks * BLOCK // 8, dtype=np.uint8)
        packed[: -(-n // 8)] = np.packbits(plane, bitorder="little")
        inside = np.bitwise_count(packed.view("<u8")).reshape(n_blocks, BLOCK // WORD, WORD // 64).sum(axis=2, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype("<u8")
        before = (np.cumsum(inside, axis=1) - inside).astype("<u2")
        data = [pack(x.tobytes()) for x in packed.reshape(n_blocks, BLOCK // 8)]
        sections.append(ones.tobytes() + before.tobytes() + np.array([len(d) for d in data], dtype="<u4").tobytes() + b"".join(data))
    return MAGIC + struct.pack("<QQI", len(doc_ids), n, bits) + b"".join(struct.pack("<Q", len(s)) + s for s in sections)


class Shard:
    """A shard's file, read."""

    def __init__(self, data: bytes, cached: int = 64):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        docs, self.n, self.bits = struct.unpack_from("<QQI", data, 4)
        at, sections = 24, []
        while at < len(data):
            (size,) = struct.unpack_from("<Q", data, at)
            sections.append(data[at + 8 : at + 8 + size])
            at += 8 + size
        self.unpack = zstandard.ZstdDecompressor().decompress
        plain = [self.unpack(s) for s in sections[:3]]
        null = np.unpackbits(np.frombuffer(plain[1], dtype=np.uint8))[:docs].astype(bool)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(plain[0], "<i8").tolist(), null.tolist())]
        self.lengths = np.frombuffer(plain[2], "<u4").astype(np.int64)
        self.n_blocks = m = -(-self.n // BLOCK)
        self.planes = []  # ones before blocks, ones before words, where blocks begin, the section
        for s in sections[3:]:
            ones = np.frombuffer(s, "<u8", m + 1).astype(np.int64)
            before = np.frombuffer(s, "<u2", m * BLOCK // WORD, 8 * (m + 1)).reshape(m, BLOCK // WORD)
            head = 8 * (m + 1) + 2 * before.size
            sizes = np.frombuffer(s, "<u4", m, head).astype(np.int64)
            self.planes.append((ones, before, np.concatenate([[0], np.cumsum(sizes)]) + head + 4 * m, s))
        self.zeros = [self.n - int(p[0][-1]) for p in self.planes]
        self.cache: OrderedDict = OrderedDict()
        self.cached = cached

    def _block(self, level: int, k: int) -> np.ndarray:
        """A block's bits in words of 64."""
        if (level, k) not in self.cache:
            _, _, at, s = self.planes[level]
            self.cache[level, k] = np.frombuffer(self.unpack(s[at[k] : at[k + 1]]), dtype="<u8")
            if len(self.cache) > self.cached:
                self.cache.popitem(last=False)
        return self.cache[level, k]

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        k, at = divmod(i, BLOCK)
        ones, before, _, _ = self.planes[level]
        if not at:
            return int(ones[k])
        words, w = self._block(level, k), at // WORD
        last, over = divmod(at, 64)
        out = int(ones[k]) + int(before[k, w]) + int(np.bitwise_count(words[w * WORD // 64 : last]).sum())
        return out + ((int(words[last]) & (1 << over) - 1).bit_count() if over else 0)

    def _find(self, level: int, bit: int, j: int) -> int:
        """Where the j-th (from 0) such bit of a plane stands."""
        ones, before, _, _ = self.planes[level]
        upto = ones if bit else np.minimum(np.arange(self.n_blocks + 1) * BLOCK, self.n) - ones
        k = int(np.searchsorted(upto, j, side="right")) - 1
        j -= int(upto[k])
        inside = before[k] if bit else np.arange(BLOCK // WORD) * WORD - before[k].astype(np.int64)
        w = int(np.searchsorted(inside, j, side="right")) - 1
        part = self._block(level, k)[w * WORD // 64 : (w + 1) * WORD // 64]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little")
        return k * BLOCK + w * WORD + int(np.flatnonzero(bits == bit)[j - int(inside[w])])

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            k, at = divmod(i, BLOCK)
            bit = int(self._block(level, k)[at // 64]) >> at % 64 & 1
            ones = self._ones(level, i)
            out, i = out << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            bit = token >> (self.bits - 1 - level) & 1
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if bit else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        a, b = self._range(token, 0, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Where a token's j-th (from 0) occurrence stands."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def _plane(self, level: int) -> np.ndarray:
        _, _, at, s = self.planes[level]
        packed = b"".join(self.unpack(s[at[k] : at[k + 1]]) for k in range(self.n_blocks))
        return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=self.n, bitorder="little").astype(bool)

    def occurrences(self, token: int) -> list[int]:
        """All of a token's places: one by one if they are few, else each plane is opened once for all of them."""
        a, b = self._range(token, 0, self.n)
        if b - a <= 16:
            return [self.select(token, j) for j in range(b - a)]
        at = np.arange(a, b)
        for level in reversed(range(self.bits)):
            plane = self._plane(level)
            at = np.flatnonzero(plane)[at - self.zeros[level]] if token >> (self.bits - 1 - level) & 1 else np.flatnonzero(~plane)[at]
        return at.tolist()

    def tokens(self) -> np.ndarray:
        """All ids in order: from the lowest plane up, each plane's partition is undone."""
        kind = _kind(self.bits)
        values = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.bits)):
            bits, out, z = self._plane(level), np.empty_like(values), self.zeros[level]
            out[np.flatnonzero(~bits)] = values[:z]
            out[np.flatnonzero(bits)] = values[z:] | kind(1 << (self.bits - 1 - level))
            values = out
        return values


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write documents' ids, each with the end id, as shards in ascending order of the documents' ids."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, k, docs, lengths, parts, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def put():
            file = build(docs, lengths, np.frombuffer(b"".join(parts), dtype="<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([n], pa.int64()), pa.array([file], pa.binary())], names=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in tokens.slices(texts):
                for doc, got in zip(ids[a:b], tokens.encode_texts(tokenizer, [t or "" for t in texts.slice(a, b - a).to_pylist()])):
                    docs.append(doc)
                    lengths.append(len(got) // 4 + 1)
                    parts.append(got + end)
                    n += lengths[-1]
                    if n >= shard:
                        yield put()
                        k, docs, lengths, parts, n = k + 1, [], [], [], 0
        if docs:
            yield put()

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS).write.option("maxRecordsPerFile", 1).option("compression", "none").mode("errorifexists").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """From the files, one row a document: its place in the whole order, its length and its ids' crc32."""
    files = spark.read.schema(SHARDS).parquet(path)

    def run(batches):
        for batch in batches:
            for part, k, file in zip(*(batch.column(c).to_pylist() for c in range(3))):
                shard = Shard(file)
                ids, ends = shard.tokens().astype("<u4"), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                m = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([k] * m, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=[c.split()[0] for c in READ.split(", ")])

    sizes = files.select("part", "shard", "n_tokens")
    # a row for each partition of the writing job meets in one task
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    starts = sizes.withColumn("within", within).join(parts, "part").select("part", "shard", (F.col("base") + F.col("within")).alias("first"))
    docs = files.select("part", "shard", "file").mapInArrow(run, READ)
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(df: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None, **columns) -> DataFrame:
    """Write the shards (to the shared work folder unless told otherwise) and read them back."""
    spark = df.sparkSession
    path = path or f"{Workspace(spark).dir}/shards"
    write_shards(df, path, tokenizer, end_id, **columns)
    return read_shards(spark, path)
