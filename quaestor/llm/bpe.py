"""BPE encoding by an index of pair occurrences, and decoding.

The words of a batch that aren't known yet lie in one array of symbols. An index maps each pair's rank to all its
positions there. Active ranks are taken in ascending order; each position still holding the pair is merged, and the
two pairs that a merge makes are added to their ranks' lists. A rank's positions are taken from left to right, and
a merge never makes a pair of lower rank than its own (checked when a vocabulary is loaded), so the result is that
of merging each word alone.

Null and empty texts give no ids and an empty decoding. Rows repeat freely; columns besides the id and the text are
not read; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from array import array
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairIndex:
    """Encodes many words at once."""

    def __init__(self, tok: tokens.Tokenizer):
        vocab, self.suffix, self.special = tok.vocab, tok.suffix, tok.special
        self.tok, self.size = tok, max(vocab.values()) + 1
        self.first = {c: (vocab.get(c), vocab.get(c + tok.suffix)) for c in tokens.byte_letters()}
        if any(x is None for pair in self.first.values() for x in pair):
            raise ValueError("a vocabulary without a byte of its own for every byte")
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in tok.merges]
        self.rank = {a * self.size + b: r for r, (a, b, _) in enumerate(self.merges)}
        made = {new: r for r, (_, _, new) in enumerate(self.merges)}
        if any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(self.merges) for x in (a, b)):
            raise ValueError("a merge comes before those that make its parts")

    def encode(self, words: list[str]) -> list[list[int]]:
        sym: list[int] = []
        starts, first = [0], self.first
        for w in words:
            if w in self.special:
                sym.append(self.special[w])
            else:
                letters = tokens.lettered(w)
                sym.extend([first[c][0] for c in letters[:-1]])
                sym.append(first[letters[-1]][1])
            starts.append(len(sym))
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts[1:]:
            after[s - 1] = -1
        for s in starts[:-1]:
            before[s] = -1
        rank, size, merges = self.rank.get, self.size, self.merges
        index: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (r := rank(sym[i] * size + sym[j])) is not None:
                index.setdefault(r, []).append(i)
        active = list(index)
        heapify(active)

        def seen(i: int, r: int) -> None:
            if r in index:
                index[r].append(i)
            else:
                index[r] = [i]
                heappush(active, r)

        while active:
            r = heappop(active)
            a, b, new = merges[r]
            for i in sorted(index.pop(r)):
                j = after[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (q := rank(new * size + sym[k])) is not None:
                        seen(i, q)
                if (p := before[i]) >= 0 and (q := rank(sym[p] * size + new)) is not None:
                    seen(p, q)
        return [[x for x in sym[s:e] if x >= 0] for s, e in zip(starts, starts[1:])]


class Decoder:
    """Text of ids as the library decodes them, special tokens kept."""

    def __init__(self, tok: tokens.Tokenizer):
        self.text = {i: t for t, i in tok.vocab.items()} | {i: t for t, i in tok.special.items()}
        self.plain = tok.lib.decoder is None
        self.lib = tok.lib

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in its file, a tokenizer's tokens stand as they are, with spaces between."""
        return " ".join(map(self.text.__getitem__, ids)) if self.plain else self.lib.decode(ids, skip_special_tokens=False)


def index_memo(path: str) -> tokens.Memo:
    """Words to their ids as little-endian 32-bit bytes and, where that is word by word, their decoding."""
    index = PairIndex(tokens.load(path))
    decoder = Decoder(index.tok)
    text = decoder.text.__getitem__
    out = tokens.Memo(index.tok, lambda words: [(array("I", ids).tobytes(), " ".join(map(text, ids)) if decoder.plain else "") for ids in index.encode(words)])
    out.decoder = decoder
    return out


def encode_decode(texts: list[str], tokenizer: str) -> list[tuple[memoryview, str]]:
    """For each text its ids, as little-endian 32-bit bytes, and their decoding."""
    memo = tokens.memo("pairs", tokenizer, index_memo)
    values, words = memo.values_of(texts)
    ids, ends = tokens.laid_out([v[0] for v in values], words)
    said, of, out, a, x = [v[1] for v in values], words.of.to_numpy(), [], 0, 0
    for b, y in zip(words.ends.tolist(), ends.tolist()):
        part = ids[x:y]
        out.append((memoryview(part), " ".join(map(said.__getitem__, of[a:b].tolist())) if memo.decoder.plain else memo.decoder.decode(part.tolist())))
        a, x = b, y
    return out


def bpe_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its number of ids and digests of the ids and of their decoding."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.slices(texts):
                rows = [(len(x), hashlib.sha256(x).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for x, d in encode_decode([t or "" for t in texts.slice(a, b - a).to_pylist()], tokenizer)]
                n, x, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(x), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: doc_id, ids."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.slices(texts):
                got = [x.tolist() for x, _ in encode_decode([t or "" for t in texts.slice(a, b - a).to_pylist()], tokenizer)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
