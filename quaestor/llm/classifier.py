"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of a whole text (lengths, shares of kinds of bytes, repetition of words, word pairs and lines) are
standardised; random cosines approximate a Gaussian kernel over them. Partitions sum their parts of the normal
equations; the ridge solution scores a text, and a monotone map fitted on labelled rows that the solution hasn't
seen turns the score into a probability. Fitting takes MOST labelled rows at most, chosen by a hash of their ids
before their texts are read.

A null text counts as empty, and both are scored. Null ids and null labels take no part in fitting; a row with
several labels has their least. Where one class is missing, every score is that class's share. Repeated rows are
scored each (of a labelled id that repeats, one row is fitted on); columns besides the id and the text are kept by keep(); a table without rows gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import held

FEATURES, WIDTH, RIDGE, SEED = 192, 4.0, 1.0, 20240229
MOST = 40_000  # labelled rows that are fitted on, about
PARTS = 12  # partitions that sum normal equations
THRESHOLD = 0.3

_upper, _lower, _digit = (np.arange(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))
_symbols, _marks, _loud = (np.array([ord(c) for c in s]) for s in ("#*$%&|<>@^~_=+{}[]\\/", ".,;:'\"()-", "!?"))
N_STATS = 16


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    size, words, lines = max(1, int(raw.sum())), text.split(), text.split("\n")
    n = max(1, len(words))
    letters = max(1, int(raw[_upper].sum() + raw[_lower].sum()))
    unique = len(set(words)) / n
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    again = sum(map(str.__eq__, words, words[1:])) / n
    of = lambda chars, total: float(raw[chars].sum()) / total
    return [
        math.log1p(len(text)), math.log1p(len(words)), len(text) / n, unique, min(1.0, pairs), again,
        len(set(lines)) / len(lines), math.log1p(len(lines)), math.log1p(size / len(lines)),
        of(_upper, letters), of(_digit, size), math.sqrt(of(_symbols, size)), of(_marks, size), math.sqrt(of(_loud, size)),
        float(raw[128:].sum()) / size, float(raw[9:14].sum() + raw[32]) / size,
    ]


def stats_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, N_STATS)


class Model:
    """Standardisation, random cosines, ridge weights and the monotone map."""

    def __init__(self, mean, spread, weights=None, share=0.5, knots=None, seed=SEED):
        self.mean, self.spread, self.weights, self.share, self.knots = mean, spread, weights, share, knots
        rng = np.random.default_rng(seed)
        self.turn, self.shift = rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES)), rng.uniform(0, 2 * math.pi, FEATURES)

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.cos(x @ self.turn + self.shift) * math.sqrt(2 / FEATURES)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated share, with a thousandth of the raw score so that its steps keep an order."""
        if self.weights is None:
            return np.full(len(stats), self.share)
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares monotone map: neighbours that fall are pooled; equal x begin as one."""
    values, first = np.unique(x, return_index=True)
    order = np.argsort(x, kind="stable")
    sums = np.add.reduceat(y[order], np.searchsorted(x[order], values))
    counts = np.diff(np.append(np.searchsorted(x[order], values), len(x)))
    pools: list[list[float]] = []  # sum, count, least x, greatest x
    for v, s, c in zip(values.tolist(), sums.tolist(), counts.tolist()):
        pools.append([s, c, v, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, _, high = pools.pop()
            pools[-1][0] += s2
            pools[-1][1] += c2
            pools[-1][3] = high
    ends = [(p[k], p[0] / p[1]) for p in pools for k in ((2, 3) if p[3] > p[2] else (2,))]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> Model:
    """A model from labelled documents that are not held out; a quarter of those fitted on calibrate."""
    held.bounded(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min("y").cast("double").alias("y")).where(fold > 0)
    total = marks.count()
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) < int(min(1.0, most / max(1, total)) * (1 << 20))

    def stats(batches):
        for batch in batches:
            got = stats_matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(got), pa.list_(pa.float64()))], names=["doc_id", "s"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(chosen & (fold > 0))
    # an id that repeats has the least of its statistics, so that no more rows meet than labels were chosen
    each = texts.mapInArrow(stats, "doc_id long, s array<double>").groupBy("doc_id").agg(F.min("s").alias("s"))
    rows = each.join(marks.where(chosen), "doc_id").select("s", "y", (fold == 1).alias("calibrates")).repartition(PARTS).cache()

    def arrays(batch):
        s = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, N_STATS)
        return s, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)

    def summed(df, one, size):
        """The sum over partitions of what one(stats, labels, calibrates) gives: a row of `size` numbers from each."""

        def run(batches):
            out = np.zeros(size)
            for batch in batches:
                out += one(*arrays(batch))
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["v"])

        return sum((np.frombuffer(bytes(r["v"])) for r in df.mapInArrow(run, "v binary").collect()), np.zeros(size))

    try:
        first = summed(rows, lambda s, y, c: np.concatenate([[len(y), y.sum()], s.sum(0), (s * s).sum(0)]), 2 + 2 * N_STATS)
        n, ones = first[0], first[1]
        if not 0 < ones < n:
            return Model(np.zeros(N_STATS), np.ones(N_STATS), share=0.5 if not n else float(ones / n))
        mean = first[2 : 2 + N_STATS] / n
        spread = np.sqrt(np.maximum(first[2 + N_STATS :] / n - mean * mean, 0))
        model, d = Model(mean, np.where(spread > 1e-9, spread, 1.0)), FEATURES + 1

        def normal(s, y, c):
            x, t = model.cosines(s[~c]), y[~c]
            return np.concatenate([(x.T @ x).ravel(), x.T @ t])

        eq = summed(rows, normal, d * d + d)
        model.weights = np.linalg.solve(eq[: d * d].reshape(d, d) + RIDGE * np.eye(d), eq[d * d :])

        def raw(batches):
            for batch in batches:
                s, y, c = arrays(batch)
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(s[c])), pa.array(y[c])], names=["x", "y"])

        seen = rows.mapInArrow(raw, "x double, y double").toPandas()  # a quarter of MOST rows
        if not len(seen):
            model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        else:
            model.knots = isotonic(seen["x"].to_numpy(), seen["y"].to_numpy())
        return model
    finally:
        rows.unpersist()


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(stats_matrix([t if isinstance(t, str) else None for t in texts])))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be of quality, with docs' columns."""
    return docs.where(score(fit(docs, labels), F.col("text")) >= THRESHOLD)
