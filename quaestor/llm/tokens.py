"""Exact tokenisation of whole texts through memoised words.

A text is cut into the pre-tokeniser's words, whose tokens don't depend on what stands beside them. Texts are taken in
slices; a slice's words are dictionary-encoded, so that each distinct word is looked up once a slice and worked out
once a worker. The memo has two generations of WORDS short words each, and the older one is dropped when the younger
is full; that changes time and not results.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from . import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORDS, LONG = 150_000, 64  # entries of a generation, and letters of the longest word that is kept

#: Below this code point case mapping, composition and letter classes don't differ between libraries.
PLAIN = 0x250
SPACES = "\t\n\x0b\f\r \x85\xa0"
SAID = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

# The pre-tokenisers whose words are known here; the words of others are asked of the library.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_ENDS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)


def _kinds() -> np.ndarray:
    """The kind of each plain character."""
    kind = lambda c: SPACE if c in SPACES else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)
    return np.array([kind(chr(c)) for c in range(PLAIN)], dtype=np.uint8)


_kind = _kinds()


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stands for itself, others are shifted up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_LETTERS = byte_letters()
_LATIN = dict(enumerate(_LETTERS))
_BACK = {ord(c): b for b, c in enumerate(_LETTERS)}


def lettered(word: str) -> str:
    """The word with one printable letter for each of its UTF-8 bytes."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", _LETTERS[32])
    return word.encode().decode("latin-1").translate(_LATIN)


def unlettered(word: str) -> str:
    return word.translate(_BACK).encode("latin-1").decode()


class Words(NamedTuple):
    """Words of several texts."""

    distinct: list[str]
    of: pa.Array  # which distinct word each word is
    ends: np.ndarray  # how many words there are up to each text's end


def _is_plain(text: str) -> bool:
    return text.isascii() or int(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").max()) < PLAIN


def _endings(codes: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray, lone: np.ndarray) -> None:
    """Apostrophes that are words, and that letters follow at once, take an ending of SAID from these."""
    lone = lone[lone + 1 < len(starts)]
    lone = lone[(starts[lone + 1] == ends[lone]) & (kind[starts[lone + 1]] == LETTER)]
    if not len(lone):
        return
    is_ = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    first, second = codes[ends[lone]], codes[np.minimum(ends[lone] + 1, len(codes) - 1)]
    two = (ends[lone + 1] - starts[lone + 1] > 1) & (is_(first, "rv") & (second == ord("e")) | (first == ord("l")) & (second == ord("l")))
    take = np.where(is_(first, "stmd"), 1, np.where(two, 2, 0))
    ends[lone] += take
    starts[lone + 1] += take


def _plain_runs(texts: list[str], by_ends: bool) -> tuple[pa.Array, np.ndarray]:
    """Words of plain texts, and their number in each text.

    With word ends, words are runs of letters, single numbers and runs of others. Otherwise they are runs of one kind;
    a run after a space takes it, and of white space before another run the last character is a word if that is no space.
    """
    big = "\n".join(texts)
    codes = np.frombuffer(big.encode("utf-16-le"), dtype="<u2")
    kind, n = _kind[codes], len(codes)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    kind[bounds[:-1] - 1] = BREAK
    turn = np.empty(n + 1, dtype=bool)
    turn[0] = turn[n] = True
    np.not_equal(kind[1:], kind[:-1], out=turn[1:n])
    if by_ends:
        turn[1:n] |= kind[1:] == NUMBER
    at = np.flatnonzero(turn)
    starts, ends = at[:-1].copy(), at[1:].copy()
    runs = kind[starts] if n else kind
    lone = (codes[starts] == ord("'")) & (ends - starts == 1)
    extra = np.zeros(0, dtype=np.int64)
    if by_ends:
        _endings(codes, kind, starts, ends, np.flatnonzero(lone))
        solid = (kind != SPACE) & (kind != BREAK)
        full = (runs != SPACE) & (runs != BREAK) & (starts < ends)
    else:
        before = np.flatnonzero((runs[:-1] == SPACE) & (runs[1:] != BREAK))
        lends = codes[ends[before] - 1] == ord(" ")
        lone[before[lends] + 1] = False
        _endings(codes, kind, starts, ends, np.flatnonzero(lone))
        starts[before[lends] + 1] -= 1
        long = before[~lends & (ends[before] - starts[before] > 1)]
        extra = ends[long] - 1
        ends[before[lends]] -= 1
        ends[long] -= 1
        solid = kind != BREAK
        full = (runs != BREAK) & (starts < ends)
    starts, ends = starts[full], ends[full]
    if len(extra):
        where = np.searchsorted(starts, extra)
        starts, ends = np.insert(starts, where, extra), np.insert(ends, where, extra + 1)
    raw = np.frombuffer(big.encode(), dtype=np.uint8)
    if len(raw) == n:
        width = ends - starts
    else:
        wide = 1 + (codes >= 0x80)
        place = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(wide, out=place[1:])
        width, solid = place[ends] - place[starts], np.repeat(solid, wide)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(width, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[solid]))
    return words, np.diff(np.searchsorted(starts, bounds), prepend=0)


class Tokenizer:
    """A tokenizer file of the tokenizers library. Plain texts are cut into words here, if its pre-tokenisation is one
    of the two that are known; others are cut by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.path, self.lib = path, Library.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"not a plain BPE tokenizer: {path}")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens that look around themselves: {path}")
        if "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError(f"not a byte-level tokenizer: {path}")
        self.vocab: dict[str, int] = model["vocab"]
        self._merges = model["merges"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self._mark = os.path.commonprefix(list(self.special))
        bare = {k: v for k, v in (spec["pre_tokenizer"] or {}).items()}
        self.by_bytes = bare == BYTE_LEVEL and not spec["normalizer"] and not self.suffix
        self.by_ends = bare == WORD_ENDS and spec["normalizer"] == LOWERED and bool(self.suffix)

    @property
    def merges(self) -> list[tuple[str, str]]:
        return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in self._merges]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text, normalised; a special string is one of its own."""
        if self._special and self._mark in text and self._special.search(text):
            return [w for part in self._special.split(text) for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _ready(self, text: str) -> str | None:
        """The text as _plain_runs takes it, if it is plain and its pre-tokenisation known."""
        if (self.by_bytes or self.by_ends) and text and _is_plain(text):
            if self.by_bytes:
                return text
            low = text.lower()
            if low.isascii() or _is_plain(low):
                return low
        return None

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if (ready := self._ready(text)) is not None:
            return _plain_runs([ready], self.by_ends)[0].to_pylist()
        if self.lib.normalizer is not None:
            text = self.lib.normalizer.normalize_str(text)
        return [unlettered(w) for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def cut(self, texts: list[str]) -> Words:
        """The words of all texts, each distinct one once."""
        parts, counts = [], np.zeros(len(texts), dtype=np.int64)
        lows: dict[int, str] = {}
        for i, t in enumerate(texts):
            if not (self.special and self._mark in t) and (ready := self._ready(t)) is not None:
                lows[i] = ready
        order = [*lows, *(i for i in range(len(texts)) if i not in lows)]
        if lows:
            words, counts[list(lows)] = _plain_runs(list(lows.values()), self.by_ends)
            parts.append(words)
        flat: list[str] = []
        for i in order[len(lows) :]:
            got = self.words(texts[i])
            counts[i] = len(got)
            flat += got
        parts.append(pa.array(flat, pa.string()))
        coded = pa.concat_arrays(parts).dictionary_encode()
        ends = np.cumsum(counts)
        of = coded.indices
        if lows and flat:  # back into the order of the texts
            first = np.cumsum(counts[order]) - counts[order]
            moved = np.argsort(order, kind="stable")
            at = np.repeat(first[moved] - (ends - counts), counts) + np.arange(len(of))
            of = of.take(pa.array(at))
        return Words(coded.dictionary.to_pylist(), of, ends)


_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


class Memo:
    """What words give, by a function that is asked for many words at once."""

    def __init__(self, tok: Tokenizer, solve):
        """solve(words) gives a value, not None, for each word."""
        self.tok, self.solve, self.young, self.old = tok, solve, {}, {}

    def values_of(self, texts: list[str]) -> tuple[list, Words]:
        """The values of the texts' distinct words, and their words."""
        on = gc.isenabled()
        gc.disable()  # millions of words live for a moment, without cycles
        try:
            words = self.tok.cut(texts)
            values = list(map(self.young.get, words.distinct))
            lacking = [i for i, v in enumerate(values) if v is None]
            again = list(map(self.old.get, map(words.distinct.__getitem__, lacking)))
            missing = [words.distinct[i] for i, v in zip(lacking, again) if v is None]
            solved = iter(self.solve(missing))
            for i, v in zip(lacking, again):
                values[i] = next(solved) if v is None else v
            for i in lacking:
                if len(word := words.distinct[i]) <= LONG:
                    self.young[word] = values[i]
            if len(self.young) > WORDS:
                self.young, self.old = {}, self.young
            return values, words
        finally:
            if on:
                gc.enable()


_memos: dict[tuple[str, str], Memo] = {}


def _empty() -> None:
    _memos.clear()
    _loaded.clear()


held.holder("tokens", _empty)


def memo(kind: str, path: str, make) -> Memo:
    """The worker's own memo of that kind; there is one at a time."""
    held.enter("tokens")
    if (kind, path) not in _memos:
        _memos.clear()
        _memos[kind, path] = make(path)
    return _memos[kind, path]


def library_memo(path: str) -> Memo:
    """Ids of words from the library's own model, as little-endian unsigned 32-bit bytes."""
    tok = load(path)
    tokenize, special = tok.lib.model.tokenize, tok.special

    def solve(words):
        ids = ([special[w]] if w in special else [t.id for t in tokenize(lettered(w))] for w in words)
        return [array("I", x).tobytes() for x in ids]

    return Memo(tok, solve)


def laid_out(values: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, from those of distinct words, and where each text's ids end."""
    sizes = np.array([len(v) for v in values], dtype=np.int64) // 4
    starts = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum(sizes, out=starts[1:])
    lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(values), dtype="<u4")))
    taken = lists.take(words.of)
    ids = taken.flatten().to_numpy(zero_copy_only=False) if len(taken) else np.zeros(0, dtype="<u4")
    upto = taken.offsets.to_numpy() if len(taken) else np.zeros(1, dtype=np.int64)
    return ids, upto[words.ends].astype(np.int64) - int(upto[0])


def encode(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts in a row, as the library gives them without added special tokens, and where each text's end."""
    return laid_out(*memo("library", path, library_memo).values_of(texts))


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each whole text, as little-endian unsigned 32-bit bytes."""
    ids, ends = encode(path, texts)
    raw, bounds = ids.astype("<u4", copy=False).tobytes(), [0, *(4 * ends).tolist()]
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def slices(batch, most: int = 3_000_000):
    """Runs (start, stop) of a batch's rows whose texts have about that many bytes together."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
