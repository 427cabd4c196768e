"""Substring dedup by MinHash banding of paragraphs.

Two kinds of paragraphs are looked at. Lines of MIN_WORDS words or more have BANDS bands of ROWS minimum hashes over
their word shingles, so that a pair at the least similarity is missed once in about seventy times; pairs that share a
band are verified by the exact Jaccard similarity of their shingles. Lines of equal words form a class. Each band first
pairs its classes with that of its least line; then, of bands whose classes still lie in several components, all pairs
across components are verified, in blocks of bounded size. Similar lines of different documents are clustered by
connected components; every member but the least (by document, then line) goes.

Paragraphs that overlap, of STRIDE runs of ANCHOR words at every word of a text, have one minimum hash each. A run that
stands in the same surroundings (all words that a paragraph around it can reach) as in the least document with it is
compared with that one. Of other runs, each paragraph of MIN_WORDS words is looked up by a hash of all its words, and
compared with the least document that holds it. So any passage of MIN_WORDS words or more that two texts share is found
whole, wherever it stands, and goes from every document but the least that holds it.

A key that many rows of a batch have is dealt out in parts: a part's rows meet its own least row, and the least rows of
parts meet each other after that.

Words are runs without ASCII white space, A-Z in lower case. Null and empty texts have no paragraphs. Rows with equal
id and text are one document. Columns besides the id and the text are kept by clean(); a table without rows gives
none.
"""

from __future__ import annotations

import re
from functools import cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources.session import Workspace
from . import held
from . import shingles as S
from .tokens import slices

MIN_WORDS, SHINGLE, PERCENT = 50, 5, 80
BANDS, ROWS = 6, 3
ANCHOR, STRIDE = 24, 27  # STRIDE + ANCHOR - 1 is MIN_WORDS
SLICE = 1_000_000  # bytes of text that keys are made of at once
BLOCK = 1 << 20  # bytes of the sets that a block of lines holds
LOOSE = -1  # the surroundings of runs that are not all listed
HOT, PARTS = 16, 1021  # rows of a key in a batch, from which on the key is dealt out in parts; and how many

KEYS = "key long, part int, cls long, id long, th long, line int, pos int"
FIRST = "kind string, key long, cls long, id long, th long, line int, pos int, k_cls long, k_id long, k_th long, k_pos int"
PAIRS = "id long, th long, line int, pos int, k_id long, k_th long, k_line int, k_pos int"
LINKS = "kind string, id long, th long, line int, start int, stop int, words int, k_id long, k_th long, k_line int, k_start int, k_stop int, k_words int"

_seeds = np.random.default_rng(11).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_word = re.compile(r"[^ \t-\r]+")


def band_keys(words: np.ndarray) -> np.ndarray:
    """The bands of one line."""
    return _bands(S.rolled(words, SHINGLE), np.zeros(1, np.int64), np.array([len(words) - SHINGLE + 1]))[0]


def _bands(shingled: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A row of bands for each line, by where its shingles start and stop."""
    base = np.append(shingled ^ (shingled >> np.uint64(31)), np.uint64(0))  # a stop may be the end
    cuts = np.stack([starts, stops], axis=1).ravel()
    least = np.stack([np.minimum.reduceat(base * seed, cuts)[::2] for seed in _seeds], axis=1)
    return S.rolled_rows(least.reshape(-1, ROWS)).reshape(-1, BANDS) ^ np.arange(BANDS, dtype=np.uint64)


def _hashed(words: np.ndarray, starts: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """A hash of the n words from each start on."""
    raw, stops = memoryview(words.tobytes()), 8 * (starts + n)
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip((8 * starts).tolist(), stops.tolist())), dtype=np.uint64, count=len(starts))


def _least_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs, and for each paragraph where its least run begins; at least MIN_WORDS words."""
    runs = S.rolled(words, ANCHOR)
    seen = np.lib.stride_tricks.sliding_window_view(runs, STRIDE)
    return runs, np.arange(len(seen)) + seen.argmin(axis=1)


def anchors(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimum hashes of the overlapping paragraphs of texts laid end to end, which text each is of, where in it its words
    begin, and hashes of their surroundings."""
    firsts = np.append(0, ends[:-1])
    if not len(words) or (ends - firsts).max() < MIN_WORDS:
        return words[:0], *(np.zeros(0, dtype=np.int64) for _ in range(3))
    runs, at = _least_runs(words)
    of = np.repeat(np.arange(len(ends)), ends - firsts)
    at = at[of[: len(at)] == of[MIN_WORDS - 1 :]]  # paragraphs of one text
    at = at[np.append(True, at[1:] != at[:-1])]  # least runs never go back
    of = of[at]
    # of one run again and again, one in each paragraph stands for all
    same = (runs[at[1:]] == runs[at[:-1]]) & (of[1:] == of[:-1])
    loose = np.append(False, same) | np.append(same, False)
    keep = np.append(True, ~same | ((at - firsts[of])[1:] % STRIDE == 0))
    at, loose, of = at[keep], loose[keep], of[keep]
    # words before a text begins and after it ends are 0; no surroundings reach beyond those between two texts
    gap = STRIDE - 1
    around = np.zeros(len(words) + gap * (len(ends) + 1), np.uint64)
    around[np.arange(len(words)) + np.repeat(gap * np.arange(1, len(ends) + 1), ends - firsts)] = words
    cls = (_hashed(around, at + gap * of, MIN_WORDS + STRIDE - 1) >> np.uint64(1)).view(np.int64)
    return runs[at], of, at - firsts[of], np.where(loose, LOOSE, cls)


def passages(words: np.ndarray, keys: np.ndarray, runs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the paragraphs whose least run is one of the keys, and where that run begins; runs, at: _least_runs(words).

    Of equal paragraphs of one text that touch, those that cover all of them.
    """
    starts = np.flatnonzero(np.isin(runs[at], keys))
    whole = _hashed(words, starts, MIN_WORDS)
    if len(np.unique(whole)) == len(whole):
        return whole, at[starts]
    order = np.lexsort((starts, whole))
    keep: list[int] = []
    for i, x in enumerate(order):
        new = i == 0 or whole[order[i - 1]] != whole[x]
        last = i + 1 == len(order) or whole[order[i + 1]] != whole[x]
        if new or last or starts[order[i + 1]] > starts[keep[-1]] + MIN_WORDS:
            keep.append(x)
    return whole[keep], at[starts[keep]]


def _rows(schema: str, cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=names)


def _parts(keys: np.ndarray) -> np.ndarray:
    """The part of each row of a batch: 0, but for those of a key beyond its first HOT ones."""
    from pyspark import TaskContext

    order = np.argsort(keys, kind="stable")
    turn = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    at = np.arange(len(keys)) - np.repeat(turn, np.diff(np.append(turn, len(keys))))
    out = np.zeros(len(keys), dtype=np.int32)
    out[order] = np.where(at < HOT, 0, 1 + (at // HOT + 31 * TaskContext.get().partitionId()) % PARTS)
    return out


def _rows_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Keys, classes, texts, lines and positions of the texts' long lines and of their anchors."""
    words = S.words_of(texts)
    breaks = np.flatnonzero(words.raw == ord("\n"))
    begins, stops = np.append(0, breaks + 1), np.append(breaks, len(words.raw))
    upto = np.append(0, np.searchsorted(words.starts, stops))
    long = np.flatnonzero(np.diff(upto) >= MIN_WORDS)
    keys, of, pos, cls = anchors(words.hashes, words.ends)
    out = [(keys, cls, of, np.full(len(of), -1), pos)]
    if len(long):
        # bytes that begin a character, for places within texts
        chars = np.append(0, np.cumsum((words.raw & 0xC0) != 0x80))
        firsts = np.append(0, np.cumsum([t.count("\n") + 1 for t in texts]))  # lines
        doc = np.searchsorted(firsts, long, side="right") - 1
        start = np.append(0, np.cumsum([len(t) + 1 for t in texts]))[doc]
        x, y = upto[long], upto[long + 1]
        name = _hashed(words.hashes, x, y - x)
        bands = _bands(S.rolled(words.hashes, SHINGLE), x, y - SHINGLE + 1)
        line = long - firsts[doc]
        each = lambda v: np.repeat(v, BANDS)
        out.append((bands.ravel(), each(name.view(np.int64)), each(doc), each(line), np.full(BANDS * len(long), -1)))
        out.append((name, (chars[begins[long]] - start) << 32 | (chars[stops[long]] - start), doc, line, -2 - (y - x)))
    return tuple(map(np.concatenate, zip(*out)))


def _keys(docs: DataFrame) -> DataFrame:
    """docs: id, th, text. Anchors have line -1, their word, and the hash of their surroundings as their class.

    Lines have a row for each band with pos -1 and the hash of their words as their class, and one with that hash as
    the key, their ends in place of the class, and -2 - their words as pos.
    """

    def run(batches):
        for batch in batches:
            ids, ths, texts = batch.columns
            for a, b in slices(texts, SLICE):
                keys, cls, of, line, pos = _rows_of(texts.slice(a, b - a).to_pylist())
                if len(keys):
                    keys, of = keys.view(np.int64), pa.array(of)
                    yield _rows(KEYS, [keys, _parts(keys), cls, ids.slice(a, b - a).take(of), ths.slice(a, b - a).take(of), line.astype(np.int32), pos.astype(np.int32)])

    return docs.mapInArrow(held.task(run), KEYS)


def _starred(keys: DataFrame) -> DataFrame:
    """Rows beside the least one of their key and part. Kinds: line (as it is); band, where the classes differ; of anchors
    that another document holds, same, where the classes are equal, and live, where they differ or don't tell; and hub,
    of keys in parts, the least rows and others of the same document, which are still to meet other parts' ones."""

    def run(batches):
        first, size = None, 0  # the least row of the part that the last batch ended in, and the rows of that part so far
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            n = batch.num_rows
            if not n:
                continue
            turn = np.ones(n, dtype=bool)
            turn[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)
            starts = np.flatnonzero(turn)
            sizes = np.diff(np.append(starts, n))
            head = np.repeat(starts, sizes)
            least, own = [c[head] for c in cols], head == np.arange(n)
            goes_on = first is not None and first[0] == cols[0][0] and first[1] == cols[1][0]
            before = np.zeros(len(starts), dtype=np.int64)
            if goes_on:
                for c, v in zip(least, first):
                    c[: sizes[0]] = v
                own[0], before[0] = False, size
            if goes_on and cols[1][0] == 0 and size < HOT <= size + sizes[0]:
                yield _rows(FIRST, [["hub"], *([v] for v in (first[0], *first[2:])), *([first[k]] for k in (2, 3, 4, 6))])
            large = np.repeat((cols[1][starts] > 0) | (before + sizes >= HOT), sizes)
            held_back = large & (own | (least[3] == cols[3]) & (least[4] == cols[4]))
            first, size = [c[-1] for c in least], int(before[-1] + sizes[-1])
            cls, pos = cols[2], cols[6]
            odd, other = cls != least[2], ((least[3] != cols[3]) | (least[4] != cols[4])) & (pos >= 0)
            kinds = {"line": pos < -1, "band": (pos == -1) & odd, "same": other & ~odd & (cls != LOOSE), "live": other & (odd | (cls == LOOSE)), "hub": held_back & (pos >= -1)}
            rest = [cols[0], *cols[2:]]
            for kind, chosen in kinds.items():
                if chosen.any():
                    yield _rows(FIRST, [pa.array([kind] * int(chosen.sum())), *(c[chosen] for c in rest), *(c[chosen] for c in least[2:5]), least[6][chosen]])

    return keys.repartition("key", "part").sortWithinPartitions("key", "part", "id", "th", "line", "pos").mapInArrow(held.task(run), FIRST)


def _stars(keys: DataFrame, work: Workspace) -> DataFrame:
    """What _starred gives for whole keys."""
    first = work.write(_starred(keys), "first")
    hubs = first.where("kind = 'hub'").select("key", F.lit(0).alias("part"), "cls", "id", "th", "line", "pos")
    return first.where("kind <> 'hub'").unionByName(work.write(_starred(hubs).where("kind <> 'hub'"), "hubs"))


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Of two sorted sets."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


class Text:
    """A text with what comparisons ask of it, each worked out once."""

    def __init__(self, text: str):
        self.text, self.hashes, self.lines = text, S.word_hashes(text), _lines(text)
        self._sets: dict[int, np.ndarray] = {}

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [(m.start(), m.end()) for m in _word.finditer(self.text)]

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").lower().split()

    def line(self, k: int) -> np.ndarray:
        if k not in self._sets:
            s, e = self.lines[k]
            self._sets[k] = S.shingles(self.text[s:e], SHINGLE)
        return self._sets[k]


def compare(a: Text, b: Text, items: list[tuple[int, int, int, int]]) -> list[tuple]:
    """Links of a text with another one: items are (line, word, other's line, other's word); -1 where there is none."""
    found: list[tuple] = []
    ends: dict[int, int] = {}  # by difference of places, the end of the last passage
    for line, pos, b_line, b_pos in sorted(set(items)):
        if pos < 0:
            if _similar(a.line(line), b.line(b_line)):
                (s, e), (bs, be) = a.lines[line], b.lines[b_line]
                found.append(("paragraph", line, s, e, len(_word.findall(a.text[s:e])), b_line, bs, be, len(_word.findall(b.text[bs:be]))))
            continue
        delta = pos - b_pos
        if pos < ends.get(delta, 0):
            continue
        left = min(pos, b_pos)
        ne = np.flatnonzero(a.hashes[pos - left : pos] != b.hashes[b_pos - left : b_pos])
        low = pos - left + (int(ne[-1]) + 1 if len(ne) else 0)
        right = min(len(a.hashes) - pos, len(b.hashes) - b_pos)
        ne = np.flatnonzero(a.hashes[pos : pos + right] != b.hashes[b_pos : b_pos + right])
        high = pos + (int(ne[0]) if len(ne) else right)
        ends[delta] = high
        if high - low >= MIN_WORDS and a.words[low:high] == b.words[low - delta : high - delta]:
            found.append(("passage", -1, a.spans[low][0], a.spans[high - 1][1], high - low, -1, None, None, high - low))
    return found


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A null id stands as the least long."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _hash(id_: str, th: str):
    return F.xxhash64(F.col(id_), F.col(th)).bitwiseAND(F.lit((1 << 63) - 1))


def _sifted(docs: DataFrame, sieve) -> DataFrame:
    """docs with a column `in`: false only for documents that the sieve doesn't hold."""

    @F.pandas_udf("boolean")
    def chosen(h: pd.Series) -> pd.Series:
        return pd.Series(sieve.value.has(h))

    # asked once a row: a deterministic function would be put both into the filter and beside it
    return docs.withColumn("in", chosen.asNondeterministic()(_hash("id", "th")))


def _passage_keys(texts: DataFrame, live: DataFrame) -> DataFrame:
    """Rows like those of anchors for all paragraphs around the live runs of a document."""
    asked = texts.join(live.groupBy("id", "th").agg(F.collect_set("key").alias("keys")), ["id", "th"]).select("id", "th", "text", "keys")

    def run(batches):
        for batch in batches:
            ids, ths, texts, keys = batch.columns
            for a, b in slices(texts):
                words = S.words_of(texts.slice(a, b - a).to_pylist())
                firsts, (runs, at) = np.append(0, words.ends), _least_runs(words.hashes)
                # texts with a run have a paragraph at least; those of a text never look beyond it
                got = [passages(words.hashes[x:y], np.array(k, np.int64).view(np.uint64), runs[x:y], at[x : y - MIN_WORDS + 1] - x) for x, y, k in zip(firsts, firsts[1:], keys[a:b].to_pylist())]
                sizes = [len(g[0]) for g in got]
                key, at = (np.concatenate([g[k] for g in got]) for k in (0, 1))
                key, n = key.view(np.int64), len(key)
                each = lambda x: np.repeat(x[a:b].to_numpy(zero_copy_only=False), sizes)
                yield _rows(KEYS, [key, _parts(key), np.zeros(n, np.int64), each(ids), each(ths), np.full(n, -1, np.int32), at.astype(np.int32)])

    return asked.mapInArrow(held.task(run), KEYS)


def _across(live: DataFrame) -> DataFrame:
    """live: key, cls, comp, doc (if only one has the class), items. Similar classes of a key, across components.

    A key's classes are dealt out in pairs of blocks. Bitmaps of the sets rule out most pairs; what a task has linked
    it doesn't compare again.
    """
    sized = live.groupBy("key").agg(F.ceil(F.sum(F.octet_length("items")) / BLOCK).cast("int").alias("blocks"))
    dealt = live.join(sized, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "comp", "doc", "own", "items")

    def rows(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches):
        for (_, i, j), group in groupby(rows(batches), key=lambda r: r[:3]):
            out = _linked([r[3:] for r in group], i != j)
            if out:
                yield _rows("a long, b long", zip(*out))

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "comp", "cls").mapInArrow(held.task(run), "a long, b long")


def _linked(rows: list[tuple], across: bool) -> list[tuple[int, int]]:
    """Similar classes of rows (cls, comp, doc, own, items), one link for two components; `across`: of two blocks."""
    cls, comp, own = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
    doc = np.array([-1 if r[2] is None else 0 for r in rows])
    docs = np.array([r[2] or 0 for r in rows])
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    n, bits, out = np.array(list(map(len, sets))), S.Bitmaps([S.bitmap(x) for x in sets]), []
    for x in range(1, len(rows)):
        ys = np.flatnonzero((comp[:x] != comp[x]) & (100 * np.minimum(n[:x], n[x]) >= PERCENT * np.maximum(n[:x], n[x])))
        ys = ys[~((doc[ys] == 0) & (doc[x] == 0) & (docs[ys] == docs[x]))]
        if across:
            ys = ys[own[ys] != own[x]]
        if not len(ys):
            continue
        for y in ys[bits.differ(x, ys) <= S.most_apart(n[x], n[ys], PERCENT)].tolist():
            if comp[x] != comp[y] and _similar(sets[x], sets[y]):
                out.append((int(cls[x]), int(cls[y])))
                comp[comp == comp[y]] = comp[x]
    return out


def links(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lines (cls, id, th, line, start, stop, words); their classes (cls, rep, doc), doc being null if several
    documents have the class; links of classes (a, b); passages (as LINKS)."""
    held.bounded(df.sparkSession)
    docs = _named(df, id_col, text_col)
    first = _stars(_keys(docs), work)
    ends = F.col("cls")
    lines = first.where("kind = 'line'").select(F.col("key").alias("cls"), "id", "th", "line", F.shiftright(ends, 32).cast("int").alias("start"), ends.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("stop"), (-2 - F.col("pos")).alias("words")).dropDuplicates(["id", "th", "line"])
    lines = work.write(lines, "lines")
    doc = F.xxhash64("id", "th")
    classes = lines.groupBy("cls").agg(F.min(F.struct("id", "th", "line")).alias("rep"), F.min(doc).alias("x"), F.max(doc).alias("y"))
    classes = work.write(classes.select("cls", "rep", F.when(F.col("x") == F.col("y"), F.col("x")).alias("doc")), "classes")

    bands = first.where("kind = 'band'").select("key", "cls", "k_cls")
    side = lambda c: classes.select(F.col("cls").alias(c), *(F.col(f"rep.{f}").alias(f if c == "cls" else f"k_{f}") for f in ("id", "th", "line")))
    near = bands.select("cls", "k_cls").distinct().join(side("cls"), "cls").join(side("k_cls"), "k_cls").select("id", "th", "line", F.lit(-1).alias("pos"), "k_id", "k_th", "k_line", F.lit(-1).alias("k_pos"))
    near = work.write(near, "near")
    at = lambda rows: rows.select("id", "th", "line", "pos", "k_id", "k_th", F.lit(-1).alias("k_line"), "k_pos")
    same, live = first.where("kind = 'same'"), first.where("kind = 'live'")
    live = live.select("id", "th", "key").unionByName(live.select(F.col("k_id").alias("id"), F.col("k_th").alias("th"), "key"))

    both = lambda rows: rows.select("id", "th").unionByName(rows.select(F.col("k_id").alias("id"), F.col("k_th").alias("th")))
    wanted = work.write(both(near).unionByName(both(same)).unionByName(live.select("id", "th")).distinct(), "wanted")
    sieve = df.sparkSession.sparkContext.broadcast(S.Sieve(wanted.select(_hash("id", "th").alias("h")), "h"))
    texts = _sifted(docs, sieve).where("in").drop("in").join(wanted, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    texts = work.write(texts, "texts")
    again = _stars(_passage_keys(texts, live), work).where("kind = 'same'")
    pairs = work.write(near.unionByName(at(same)).unionByName(at(again)).distinct(), "pairs")
    grouped = pairs.groupBy("id", "th", "k_id", "k_th").agg(F.collect_list(F.struct("line", "pos", "k_line", "k_pos")).alias("items"))
    both = grouped.join(texts, ["id", "th"]).join(texts.select(F.col("id").alias("k_id"), F.col("th").alias("k_th"), F.col("text").alias("k_text")), ["k_id", "k_th"])

    def run(batches):
        last = other = None
        for batch in batches:
            out: list[tuple] = []
            for id_, th, k_id, k_th, text, k_text, items in zip(*(batch.column(n) for n in ("id", "th", "k_id", "k_th", "text", "k_text", "items"))):
                id_, th, *k = (x.as_py() for x in (id_, th, k_id, k_th))
                if k != last:  # rows of one hub mostly come together
                    last, other = k, Text(k_text.as_py())
                for kind, line, s, e, w, k_line, ks, ke, kw in compare(Text(text.as_py()), other, [(i["line"], i["pos"], i["k_line"], i["k_pos"]) for i in items.as_py()]):
                    out.append((kind, id_, th, line, s, e, w, *k, k_line, ks, ke, kw))
            if out:
                yield _rows(LINKS, zip(*out))

    found = work.write(both.select("id", "th", "k_id", "k_th", "text", "k_text", "items").mapInArrow(held.task(run), LINKS), "links")

    of = lambda c, p: classes.select(F.col("cls").alias(c), F.col("doc").alias(f"{c}_doc"), *(F.col(f"rep.{f}").alias(f"{p}{f}") for f in ("id", "th", "line")))
    linked = found.where("kind = 'paragraph'").join(of("a", ""), ["id", "th", "line"]).join(of("b", "k_"), ["k_id", "k_th", "k_line"])
    linked = work.write(linked.where("a_doc IS NULL OR b_doc IS NULL OR a_doc <> b_doc").select("a", "b"), "linked")  # lines of one document alone aren't linked

    comp = components(linked, "a", "b").select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    left = bands.select("key", "cls").unionByName(bands.select("key", F.col("k_cls").alias("cls"))).distinct().join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    left = work.write(left, "left")
    several = left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    left = work.write(left.join(several, "key", "left_semi"), "several")
    asked = left.select("cls").distinct().join(classes, "cls").select("cls", "doc", "rep.id", "rep.th", "rep.line")
    asked = asked.groupBy("id", "th").agg(F.collect_list(F.struct("cls", "doc", "line")).alias("asked")).join(texts, ["id", "th"]).select("text", "asked")

    def sets(batches):
        for batch in batches:
            for text, items in zip(*(c.to_pylist() for c in batch.columns)):
                parts = text.split("\n")
                yield _rows("cls long, doc long, items binary", zip(*((i["cls"], i["doc"], S.shingles(parts[i["line"]], SHINGLE).tobytes()) for i in items)))

    items = work.write(asked.mapInArrow(held.task(sets), "cls long, doc long, items binary"), "sets")
    rest = _across(left.join(items, "cls"))
    linked = work.write(linked.unionByName(rest).distinct(), "linked")
    work.drop(near, pairs, texts, wanted, left, items)
    return lines, classes, linked, found.where("kind = 'passage'")


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, kind, start, stop (characters of the text), words, kept_id: what goes, and the least document with it."""
    work = Workspace(df.sparkSession)
    lines, classes, linked, found = links(df, work, id_col, text_col)
    roots = components(linked, "a", "b").select(F.col("node").alias("cls"), "root")
    named = classes.join(roots, "cls", "left").where("root IS NOT NULL OR doc IS NULL").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep").alias("kept"))
    gone = lines.join(named.join(least, "root").select("cls", "kept"), "cls").where(F.struct("id", "th", "line") != F.col("kept"))
    whole = gone.select("id", "th", F.lit("paragraph").alias("kind"), "start", "stop", "words", F.col("kept.id").alias("kept_id"))
    parts = found.groupBy("id", "th", "start", "stop").agg(F.max("words").alias("words"), F.min("k_id").alias("kept_id")).select("id", "th", F.lit("passage").alias("kind"), "start", "stop", "words", "kept_id")
    return work.write(whole.unionByName(parts), "removals")


def report(df: DataFrame) -> DataFrame:
    """A row for each part that goes: doc_id, kind, start, stop, words, kept_doc_id."""
    back = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    return removals(df).select(back("id").alias("doc_id"), "kind", "start", "stop", "words", back("kept_id").alias("kept_doc_id"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those parts; lines that only they filled go too, blank lines of the text stay."""
    if not spans:
        return text
    out: list[str] = []
    gone, k = sorted(spans), 0
    for s, e in _lines(text):
        while k < len(gone) and gone[k][1] <= s:
            k += 1
        left, at, i = "", s, k
        while i < len(gone) and gone[i][0] < e:
            left += text[at : max(at, gone[i][0])]
            at = max(at, min(e, gone[i][1]))
            i += 1
        left += text[at:e]
        if i == k or left.strip():
            out.append(left)
    return "\n".join(out)


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """df with its texts cleaned (and their sizes); documents of which nothing is left go."""
    cuts = removals(df, id_col, text_col)
    spans = cuts.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    sieve = df.sparkSession.sparkContext.broadcast(S.Sieve(spans.select(_hash("id", "th").alias("h")), "h"))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    keyed = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), row)
    sifted = _sifted(keyed, sieve)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else without(t, [(x["start"], x["stop"]) for x in p]) for t, p in zip(texts, spans)], dtype=object)

    field = {c: F.col(f"row.`{c}`") for c in df.columns}
    same = sifted.where(~F.col("in")).select("row.*")
    changed = sifted.where("in").join(spans, ["id", "th"], "left")
    text = F.coalesce(field[text_col], F.lit(""))
    changed = changed.select("row", "spans", F.when(F.col("spans").isNull(), field[text_col]).otherwise(cut.asNondeterministic()(text, F.col("spans"))).alias("left"))
    changed = changed.where(F.col("spans").isNull() | (F.col("left") != ""))
    field[text_col] = F.col("left")
    if size_col in field:
        field[size_col] = F.when(F.col("spans").isNull(), field[size_col]).otherwise(F.length("left")).cast(df.schema[size_col].dataType)
    return same.unionByName(changed.select(*(v.alias(c) for c, v in field.items())))
