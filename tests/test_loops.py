"""Operators that give what a loop over rows in order gives, against that loop."""

import random

import pytest
from pyspark.sql import functions as F

from quaestor.operators.batches import token_budget
from quaestor.operators.components import component_labels
from quaestor.operators.greedy import first_without_shared_keys
from quaestor.operators.ordered import least_before, numbered


def loop(rows, held=()):
    seen, out = set(held), []
    for i, _, keys in sorted(rows, key=lambda r: (r[1], r[0])):
        keys = {k for k in keys or () if k is not None}
        if not keys & seen:
            seen |= keys
            out.append(i)
    return sorted(out)


def taken(spark, rows, held=None):
    df = spark.createDataFrame(rows, "id long, o long, ks array<string>").repartition(3)
    blocked = spark.createDataFrame([(k,) for k in held], "key string") if held else None
    return sorted(r["id"] for r in first_without_shared_keys(df, "id", F.col("ks"), "o", blocked).collect())


def test_a_chain_keeps_more_than_one_row_a_component(spark):
    chain = [(i, i, [f"k{i}", f"k{i + 1}"]) for i in range(9)]
    assert taken(spark, chain) == loop(chain) == [0, 2, 4, 6, 8]
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)], "src long, dst long")
    assert component_labels(edges).select("component").distinct().count() == 1


def test_dedup_by_two_keys_on_a_chain(spark):
    # b shares its identity with a and its meaning with c: b goes, so c stays; two passes would drop c as well or keep b
    rows = [(1, 1, ["i:x", "m:p"]), (2, 2, ["i:x", "m:q"]), (3, 3, ["i:y", "m:q"]), (4, 4, ["i:y", "m:r"]), (5, 5, ["i:z", "m:r"])]
    assert taken(spark, rows) == loop(rows) == [1, 3, 5]


@pytest.mark.parametrize("seed", range(3))
def test_random_rows_and_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randrange(40), [f"k{rnd.randrange(60)}" for _ in range(rnd.randrange(4))] + ["hot"] * (rnd.random() < 0.3)) for i in range(150)]
    rows += [(200, 0, None), (201, 0, []), (202, 1, [None]), (203, 1, [None, "k1"])]
    assert taken(spark, rows) == loop(rows)
    assert taken(spark, rows, ["k3", "hot"]) == loop(rows, ["k3", "hot"])


def test_no_rows(spark):
    assert taken(spark, []) == []


def batches(rows, budget):
    """(group, batch, id) by a fold over each group."""
    out, key, count, batch = [], object(), 0, 0
    for g, n, i in sorted(((g, max(n or 0, 0), i) for i, g, n in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if g != key:
            key, count, batch = g, 0, 0
        elif n * (count + 1) > budget:
            count, batch = 0, batch + 1
        count += 1
        out.append((g, batch, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("budget", "longest", "n"), [(100, 40, 400), (100, 3, 500), (7, 30, 200), (1000, 1000, 300), (64, 64, 1)])
def test_token_budget_is_the_fold(spark, budget, longest, n):
    rnd = random.Random(budget + longest)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([rnd.randrange(longest + 1), longest // 3, None])) for i in range(n)]
    got = token_budget(spark.createDataFrame(rows, "id long, s string, n int").repartition(3), "s", "id", "n", budget).collect()
    assert sorted(((r["s"], r["batch"], r["row_id"]) for r in got), key=repr) == batches(rows, budget)


def test_token_budget_of_no_rows(spark):
    assert token_budget(spark.createDataFrame([], "id long, s string, n int"), "s", "id", "n", 10).count() == 0


def test_scans_along_one_log(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, rnd.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    best, want = None, {}
    for k, v in rows:
        want[k] = best
        best = v if best is None else best if v is None else min(best, v)
    out = least_before(df, "v", ["k"])
    assert {r["k"]: r["best"] for r in out.collect()} == want
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    assert sorted((r["position"], r["k"]) for r in numbered(df, ["k"]).collect()) == [(i, i) for i in range(2000)]
    assert least_before(df.limit(0), "v", ["k"]).count() == 0


def test_a_ledger_that_is_not_shuffled(spark, tmp_path):
    from quaestor.operators.ledger import Ledger

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    ledger = Ledger(spark, str(tmp_path / "ledger"), 4)
    assert [ledger.append(keys("a", "b", "a", None), "x"), ledger.append(keys("b", "c"), "y"), ledger.append(keys("c"), "z")] == [2, 1, 0]
    again = Ledger(spark, str(tmp_path / "ledger"), 4)
    assert {r["key"]: r["source"] for r in again.keys().collect()} == {"a": "x", "b": "x", "c": "y"}
    rows = spark.createDataFrame([(1, ["q", "a"]), (2, ["q"]), (3, []), (4, None), (2, ["c"]), (None, ["b"]), (5, [None])], "id long, ks array<string>")
    out = again.exclude(rows, "id", F.col("ks"))
    assert sorted(r["id"] for r in out.collect()) == [3, 4, 5]
    hit = rows.select(F.explode("ks").alias("key")).join(again.keys().hint("merge"), "key", "left_semi")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("Bucketed: true")].splitlines()
    side = len(scan) - next(i for i, line in enumerate(reversed(scan)) if "Sort" in line or "Join" in line) - 1
    assert "SortMergeJoin" in plan and not any("Exchange" in line for line in scan[side:])
    assert plan.count("Exchange") == 1


def test_bootstrap_by_lists_is_that_by_a_join(spark, monkeypatch):
    from quaestor.operators import metrics

    df = spark.createDataFrame([(i % 3, i, (i * 37 % 11) / 7) for i in range(90)], "s long, i long, y double")
    one = metrics.bootstrap_interval(df, "s", "i", "y", 200, 3).first()
    monkeypatch.setattr(metrics, "LISTED", 5)
    two = metrics.bootstrap_interval(df, "s", "i", "y", 200, 3).first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(one, two)) and one["low"] < one["delta"] < one["high"]
