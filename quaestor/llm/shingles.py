"""Sets of word shingles as sorted 64-bit hashes, and filters for what a later pass must pick out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PART = 1 << 14  # words hashed at a time, which a processor's cache holds

_space = np.isin(np.arange(256), [ord(c) for c in " \t\n\x0b\f\r"])


class Words(NamedTuple):
    """Words of several texts that are laid end to end, a newline after each but the last."""

    hashes: np.ndarray
    ends: np.ndarray  # how many words there are up to each text's end
    starts: np.ndarray  # where words begin in raw
    raw: np.ndarray  # bytes, A-Z in lower case


def words_of(texts: list[str | None]) -> Words:
    """Words are runs without space, tab, newline, vertical tab, form feed and return. Each distinct one is hashed once."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=bool)
    np.logical_not(_space[raw], out=solid[1:-1])
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = turn[::2], turn[1::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid[1:-1]])])
    coded = words.dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    bounds = np.cumsum([len(x) + 1 for x in parts])
    return Words(distinct[coded.indices.to_numpy()], np.searchsorted(starts, bounds), starts, raw)


def word_hashes(text: str | None) -> np.ndarray:
    """Those of one text."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, (text or "").encode("utf-8", "surrogatepass").lower().split()), dtype=np.uint64)


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; the order of the words counts."""
    size = len(words) - n + 1
    out = np.full(size, n, dtype=np.uint64)
    for a in range(0, size, PART):
        part = out[a : a + PART]
        moved = np.empty_like(part)
        for j in range(n):
            part ^= words[a + j : a + j + len(part)]
            part *= np.uint64(MIX[0])
            np.right_shift(part, np.uint64(29), out=moved)
            part ^= moved
        part *= np.uint64(MIX[1])
    return out


def _set(words: np.ndarray, n: int) -> np.ndarray:
    if not len(words):
        return words
    return np.unique(rolled(words, n if len(words) >= n else len(words)))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of n words in a row, sorted; of fewer words, one of the whole; without words, none."""
    return _set(word_hashes(text), n)


def sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """shingles() of each text, in slices."""
    for a, b in slices(texts):
        words = words_of(texts.slice(a, b - a).to_pylist())
        every = rolled(words.hashes, n) if len(words.hashes) >= n else words.hashes
        first = 0
        for last in words.ends.tolist():
            yield np.unique(every[first : last - n + 1]) if last - first >= n else _set(words.hashes[first:last], n)
            first = last


def digest(values: np.ndarray, seed: int) -> tuple[bytes, int]:
    """128 bits of a set, and 64 bits that name it."""
    full = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return full, int.from_bytes(hashlib.blake2b(full, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little", signed=True)


def width(n: int, percent: int = 80) -> int:
    """Bits of the bitmap of a set of n: a power of two from 128 up to 65,536, of once to twice n; from 90 percent on, a
    quarter of that is enough. In fewer, as many differences as the similarity allows look like any number of them."""
    return min(1 << 16, max(128, 1 << max(0, (n - 1).bit_length() - (2 if percent >= 90 else 0))))


def bitmap(values: np.ndarray, percent: int = 80) -> bytes:
    """For each bit the parity of how many members of the set fall on it.

    Sets that differ in d members have bitmaps that differ in d bits at most. A bitmap of half the width is that of the
    two halves combined by exclusive or.
    """
    w = width(len(values), percent)
    odd = np.bincount(((values * np.uint64(MIX[1])) >> np.uint64(64 - w.bit_length() + 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def narrowed(bits: bytes, w: int) -> bytes:
    """The bitmap of that width, from one at least as wide."""
    while 8 * len(bits) > w:
        x = np.frombuffer(bits, dtype=np.uint8)
        # hashes take their highest bits, so neighbours fall together
        y = np.unpackbits(x).reshape(-1, 2)
        bits = np.packbits(y[:, 0] ^ y[:, 1]).tobytes()
    return bits


class Bitmaps:
    """Bitmaps of several sets, told apart from one of them at a time."""

    def __init__(self, bits: list[bytes]):
        self.bits, self.rows = bits, {}
        self.widths = np.array([8 * len(b) for b in bits])

    def _matrix(self, w: int) -> np.ndarray:
        """A row for each set, empty where the set's own bitmap is narrower."""
        if w not in self.rows:
            out = np.zeros((len(self.bits), w // 64), dtype=np.uint64)
            for i in np.flatnonzero(self.widths >= w).tolist():
                out[i] = np.frombuffer(narrowed(self.bits[i], w), dtype=np.uint64)
            self.rows[w] = out
        return self.rows[w]

    def differ(self, x: int, ys: np.ndarray) -> np.ndarray:
        """In how many members set x differs from each of the others, at least."""
        shared = np.minimum(self.widths[ys], self.widths[x])
        out = np.zeros(len(ys), dtype=np.int64)
        for w in np.unique(shared).tolist():
            at = np.flatnonzero(shared == w)
            m = self._matrix(w)
            out[at] = np.bitwise_count(m[ys[at]] ^ m[x]).sum(axis=1)
        return out


def most_apart(n, m, percent: int):
    """In how many members two sets of n and m may differ, if they are similar enough."""
    return n + m - 2 * (-(-percent * (n + m) // (100 + percent)))


class Sieve:
    """A Bloom filter of about SHARE bits a key; at most MOST / 8 bytes, beyond which it lets more through."""

    SHARE, LEAST, MOST = 16, 1 << 16, 1 << 27

    def __init__(self, keys: DataFrame, col: str):
        """keys[col]: non-negative hashes."""
        self.bits = min(self.MOST, max(self.LEAST, 1 << (self.SHARE * keys.count()).bit_length()))
        bit = F.explode(F.array(*(F.pmod(F.shiftright(F.col(col), 31 * k), F.lit(self.bits)) + 1 for k in range(2)))).alias("b")
        rows = keys.select(bit).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
        # buckets hold 32,768 bits each; from bit 1 on they are numbered from 1
        self.map = np.zeros((self.bits // 32768 + 2) * 4096, dtype=np.uint8)
        for r in rows:
            self.map[4096 * r["n"] : 4096 * (r["n"] + 1)] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)

    def has(self, keys) -> np.ndarray:
        """For each key (an Arrow or pandas column, or an array) whether it may be one of the sieve's."""
        keys = np.asarray(keys.to_numpy(zero_copy_only=False) if isinstance(keys, pa.Array) else keys).astype(np.int64)
        out = np.ones(len(keys), dtype=bool)
        for k in range(2):
            b = (keys >> 31 * k) % self.bits
            out &= self.map[4096 + b // 8] >> (b % 8) & 1 == 1
        return out


def rolled_rows(values: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix."""
    out = np.full(len(values), values.shape[1], dtype=np.uint64)
    for j in range(values.shape[1]):
        out = (out ^ values[:, j]) * np.uint64(MIX[0])
        out ^= out >> np.uint64(29)
    return out * np.uint64(MIX[1])
