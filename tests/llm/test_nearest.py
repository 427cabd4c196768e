"""The search over several blocks against brute force."""

import numpy as np
import pytest

pytest.importorskip("pyarrow")

from quaestor.llm import ann  # noqa: E402


def nearest(ids, x, q, k=20):
    """Ids and scores by brute force, rows of the query's own id left out."""
    scores = np.einsum("d,nd->n", x[np.flatnonzero(ids == q)[0]], x)
    at = np.flatnonzero(ids != q)
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return ids[at], scores[at]


def search(spark, ids, x, block):
    rows = spark.createDataFrame([(None if i is None else int(i), v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, b string").repartition(3)
    got = {}
    for r in ann.search(rows, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return got


def test_several_blocks_with_ties_and_a_hot_vector(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 24)) * 3
    x = centres[draw.integers(0, 12, 1500)] + 0.3 * draw.normal(size=(1500, 24))
    x[600:1100] = x[7]  # a third of all rows: more than one block of 100 holds them
    ids = np.arange(1500)
    got = search(spark, [*ids, None], np.vstack([x, x[:1]]), 100)
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        want, scores = nearest(ids, x, q)
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(s == np.einsum("d,nd->n", x[q], x[i : i + 1])[0] or abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in found)
        hits += np.isclose([f[2] for f in found], scores).sum()
        if q in range(600, 1100):  # equal scores go by the smaller id, across blocks too
            tied = [f[1] for f in found if f[2] == found[0][2]]
            assert tied == sorted(tied)
    assert hits >= 0.98 * 20 * len(got)


def test_fewer_rows_than_asked_for_and_repeated_rows(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], [0.0, 1.0]])
    got = search(spark, [20, 20, 1, 2], x, 1)
    assert {q: [f[1] for f in v] for q, v in got.items()} == {20: [1, 2]}


def test_blocks_far_away_are_not_asked(spark):
    draw = np.random.default_rng(9)
    x = np.repeat(draw.normal(size=(16, 24)) * 5, 64, axis=0) + 0.05 * draw.normal(size=(1024, 24))
    norm = float(np.sqrt((x * x).sum(1).max()))
    g = ann.gauss(24)
    p = x @ g[:-1] + np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))[:, None] * g[-1]
    blocks = ann.Splits(p, 4).blocks(p)
    assert np.bincount(blocks, minlength=16).max() <= 2 * 64
    whole = ann.Block(np.arange(1024), x, norm)
    _, _, _, seen = whole.search(np.arange(0, 1024, 16), x[::16], np.full(64, -np.inf), 20)
    assert seen < 0.8 * 64 * 1024
    _, found, score, _ = whole.search(np.arange(0, 1024, 16), x[::16], np.full(64, np.inf), 20)
    assert not len(found) and not len(score)
