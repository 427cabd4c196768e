"""Sharding of linked documents, thresholds of quality rules and the classifier's parts, against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("xxhash")
duckdb = pytest.importorskip("duckdb")

from quaestor.llm import classifier, quality_rules, sharding  # noqa: E402


def spread(spark, rows, n_shards):
    """Shards by text, after the law is checked."""
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n_shards).collect()
    by, slots = defaultdict(Counter), defaultdict(list)
    texts = {d: t for d, t in rows if d is not None}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            by[texts[r["doc_id"]]][r["shard"]] += 1
    sizes = [len(slots[s]) for s in range(n_shards)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    return by


@pytest.mark.parametrize("size", [2, 5])
def test_small_groups_come_together_though_no_place_is_free(spark, size):
    by = spread(spark, [(i, f"text {i // size}") for i in range(4000)], 40)
    assert sum(len(x) == 1 for x in by.values()) >= 0.95 * len(by)


def test_a_group_larger_than_shards_fills_few_and_the_rest_stay_whole(spark):
    rows = [(i, "hot") for i in range(1000)] + [(1000 + i, f"t{i // 3}") for i in range(1200)] + [(3000 + i, f"alone {i}") for i in range(797)] + [(None, "hot"), (None, None), (7, "hot")]
    by = spread(spark, rows, 30)
    assert len(by["hot"]) <= 13  # 1,003 documents, 100 to a shard
    small = [x for t, x in by.items() if t.startswith("t")]
    assert sum(len(x) == 1 for x in small) >= 0.95 * len(small)
    cut = sum((sum(x.values()) ** 2 - sum(n * n for n in x.values())) / 2 for x in small)
    assert cut <= 0.05 * 3 * len(small)


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    assert sharding._buckets(10**6) == sharding.BUCKETS and sharding._buckets(10**11) == 10**5
    monkeypatch.setattr(sharding, "BUCKETS", 2)
    monkeypatch.setattr(sharding, "ROWS", 50)
    by = spread(spark, [(i, f"text {i // 2}") for i in range(900)] + [(1000 + i, f"alone {i}") for i in range(300)], 5)
    assert sum(len(by[f"text {i}"]) == 1 for i in range(450)) >= 0.95 * 450


def test_all_texts_equal_and_few_rows(spark):
    assert len(spread(spark, [(i, "same") for i in range(50)], 7)["same"]) == 7
    spread(spark, [(i, None) for i in range(3)], 7)


def test_quotas_keep_shards_to_what_they_may_hold():
    rnd = random.Random(2)
    for _ in range(30):
        held = [rnd.randrange(50, 150) for _ in range(6)]
        asked = [[0 if i == j else rnd.randrange(20) for j in range(6)] for i in range(6)]
        let = sharding.quotas(held, asked, 130)
        for j in range(6):
            came = sum(let[i][j] * asked[i][j] for i in range(6))
            assert came < 1e-6 or held[j] + came - sum(let[j][i] * asked[j][i] for i in range(6)) < 140


def test_rules_agree_with_their_sql_where_groups_are_large(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda n, s: "\n".join(" ".join(rnd.choice(["stone", "river", "a", "walking", s, "light"]) for _ in range(12)) for _ in range(n))
    rows = [(i, text(rnd.randint(4, 9), rnd.choice(["#", "and", "x" * 30])), ["en", "de"][i % 2], ["hot", "cold"][i % 7 == 0]) for i in range(900)] + [(901, None, None, None), (902, text(6, "##"), None, "hot")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = Counter(con.execute(quality_rules.ORACLE).fetchall())
    got = Counter(tuple(r) for r in quality_rules.quality_rules(docs).collect())
    assert got == want and 0 < sum(r[-1] for r in got) < len(rows)
    assert sorted(r["doc_id"] for r in quality_rules.filter_documents(docs).collect()) == sorted(r[0] for r in want if r[-1])


def test_ridge_is_that_of_all_rows_at_once(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["stone", "river.", "A", "x1", "##"][: 3 + i % 3]) for _ in range(20 + i % 50))) for i in range(300)]
    marks = {i: int(i % 3 > 0) for i, _ in rows}
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string").repartition(4)
    model = classifier.fit(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    used = [(i, t) for i, t in rows if fold(i) > 0]
    stats = classifier.stats_matrix([t for _, t in used])
    y, apart = np.array([marks[i] for i, _ in used], float), np.array([fold(i) == 1 for i, _ in used])
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.spread, np.where(stats.std(0) > 1e-9, stats.std(0), 1.0))
    x = model.cosines(stats)
    kept = x[~apart]
    want = np.linalg.solve(kept.T @ kept + classifier.RIDGE * np.eye(x.shape[1]), kept.T @ y[~apart])
    assert np.allclose(model.weights, want, atol=1e-7)
    knots, values = classifier.isotonic(model.raw(stats[apart]), y[apart])
    assert np.allclose(model.knots[0], knots, atol=1e-6) and np.allclose(model.knots[1], values, atol=1e-9)


def test_isotonic_is_the_least_squares_monotone_map():
    rng = np.random.default_rng(8)
    for _ in range(20):
        x, y = rng.integers(0, 12, size=40).astype(float), rng.integers(0, 2, size=40).astype(float)
        at = np.unique(x)
        mean = lambda lo, hi: y[(x >= lo) & (x <= hi)].mean()
        want = [max(min(mean(lo, hi) for hi in at if hi >= v) for lo in at if lo <= v) for v in at]
        assert np.allclose(np.interp(at, *classifier.isotonic(x, y)), want)
