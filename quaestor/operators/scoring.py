"""A pluggable scorer, typed answers and ensembles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.keys import col


def vector_logits(vector: str, gold, k: int, scale: float = 3.0) -> Column:
    """A linear scorer of vectors: option i's logit is the sum of every k-th component from the i-th on, higher for the
    gold one. Components that are null or not a number count as zero."""
    said = lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))
    own = lambda i: F.aggregate(F.filter(col(vector), lambda x, at: at % k == i), F.lit(0.0), lambda a, x: a + said(x))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: own(i) * scale + F.when(i == col(gold), 1.5).otherwise(0.0))


def scored(df: DataFrame, prompt: str, n_labels: str, score: Callable[[list[str], list[int]], list[list[float]]], out: str = "logits") -> DataFrame:
    """Adds logits by a batch function of prompts and their numbers of labels. Prompts of like length share batches."""

    @F.pandas_udf("array<double>")
    def run(prompts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series(score(prompts.tolist(), counts.tolist()))

    return df.sortWithinPartitions(F.length(prompt)).withColumn(out, run(prompt, n_labels))


def answered(requests: DataFrame, prepare: Callable, score: Callable, parts: int = 1) -> DataFrame:
    """Answers of questions about states: request_id, name, choice, probabilities, confidence and raw (the logits).

    `requests` has request_id, state, name, question and keys (as many as the question has options). Rows meet by
    state, each state's in `parts` parts by a hash of the request, and in each part prepare(state) is called once for
    all of its questions; score(prepared, questions, numbers of options) gives a list of logits for each question. A
    question without options, or whose logits are of another number or not finite, fails the job.
    """

    def run(batches):
        known, prepared = None, None
        for pdf in batches:
            out = []
            for state, rows in pdf.groupby("state", sort=False, dropna=False):
                if known != (state,):
                    known, prepared = (state,), prepare(state)
                logits = score(prepared, rows["question"].tolist(), [len(k) for k in rows["keys"]])
                for (request, name, keys), z in zip(rows[["request_id", "name", "keys"]].itertuples(index=False), logits):
                    z = np.asarray(z, dtype=np.float64)
                    if not len(keys) or z.shape != (len(keys),) or not np.isfinite(z).all():
                        raise ValueError(f"request {request}, question {name}: {len(keys)} options and logits {z.tolist()}")
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    out.append((request, name, keys[int(p.argmax())], dict(zip(keys, p.tolist())), float(p.max()), z.tolist()))
            yield pd.DataFrame(out, columns=["request_id", "name", "choice", "probabilities", "confidence", "raw"])

    dealt = requests.select("request_id", "state", "name", "question", "keys", F.pmod(F.xxhash64("request_id"), F.lit(parts)).alias("_part"))
    dealt = dealt.repartition("state", "_part").sortWithinPartitions("state", "request_id", "name").drop("_part")
    kind = dict(requests.dtypes)["request_id"]
    return dealt.mapInPandas(run, f"request_id {kind}, name string, choice string, probabilities map<string,double>, confidence double, raw array<double>")


def choice_answer(keys: Column, p: Column) -> Column:
    return F.struct(F.get(keys, V.argmax(p).cast("int")).alias("choice"), F.round(F.array_max(p), 4).alias("probability"), F.round(V.entropy_confidence(p), 4).alias("confidence"))


def two_orders(p: Column, reversed_p: Column) -> Column:
    """The mean of a distribution and of that asked in reversed order, aligned and scaled to 1."""
    mean = F.zip_with(p, F.reverse(reversed_p), lambda a, b: (a + b) / 2)
    return F.transform(mean, lambda x: x / V.total(mean))
