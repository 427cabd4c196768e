"""Similarity joins and paragraph dedup on dense and hot groups, against all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("xxhash")

from quaestor.llm import jaccard_join  # noqa: E402
from quaestor.llm import shingles as S  # noqa: E402

from test_llm import plain_components  # noqa: E402


def test_bitmaps_never_differ_in_more_bits_than_sets_in_members():
    rng = np.random.default_rng(1)
    for n in (1, 5, 200, 3000):
        x = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64))
        for d in (0, 1, n // 10, n):
            y = np.unique(np.concatenate([x[d:], rng.integers(0, 1 << 63, size=rng.integers(0, d + 1), dtype=np.uint64)]))
            differ = len(np.setxor1d(x, y))
            a, b = S.bitmap(x), S.bitmap(y)
            got = S.Bitmaps([a, b]).differ(0, np.array([0, 1]))
            w = 8 * min(len(a), len(b))
            plain = (int.from_bytes(S.narrowed(a, w)) ^ int.from_bytes(S.narrowed(b, w))).bit_count()
            assert got[0] == 0 and got[1] == plain <= differ


@pytest.mark.parametrize("least", [False, True])
def test_a_hot_group_of_near_copies_in_parts_and_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard_join, "HOT", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    rnd = random.Random(19)
    base = [f"w{i}" for i in range(80)]
    rows = [(3 * i + 7, " ".join(rnd.choice(base) if rnd.random() < (0.004, 0.012, 0.03)[i % 3] else w for w in base[: rnd.randint(76, 80)])) for i in range(150)]
    rows += [(3 * i + 8, rows[i][1]) for i in range(0, 150, 5)]
    rows += [(1, " ".join(base))] if least else []
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, 3, 90)


def test_a_sieve_lets_all_of_its_keys_through(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 62, size=5000)
    sieve = S.Sieve(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h")
    assert sieve.has(keys).all() and sieve.has(rng.integers(0, 1 << 62, size=5000)).mean() < 0.05


def test_a_passage_of_many_documents_is_cut_from_all_but_the_least(spark):
    from test_llm import plain_gone, reported_gone

    rnd = random.Random(23)
    words = lambda k, n: [f"{k}{rnd.randrange(10**9)}" for _ in range(n)]
    passage = words("p", 90)
    rows = []
    for d in range(120):
        cut = passage[: rnd.choice([90, 90, 70, 49])] if d % 3 else passage[rnd.choice([0, 10, 41]) :]
        rows.append((d, "\n".join([" ".join(words("a", rnd.randrange(1, 30))), " ".join(cut[:45]), " ".join(cut[45:]), " ".join(words("b", rnd.randrange(1, 30)))])))
    assert reported_gone(spark, rows) == plain_gone(rows)
