"""Operators on small cases worked out by hand."""

import gzip
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quaestor.functions import keys, vectors
from quaestor.operators import examples, selection
from quaestor.operators.components import component_labels
from quaestor.operators.manifest import write_manifest, write_splits
from quaestor.sources import readers


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 5)] + [(300 + rnd.randrange(40), 300 + rnd.randrange(40)) for _ in range(30)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in component_labels(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_without_edges(spark):
    assert component_labels(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_json_keys_ignore_order_and_space(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": [2]}',), ('{"b":[2],"a":1}',), ('{"a": 2}',)], "s string")
    a, b, c = (r[0] for r in rows.select(keys.json_digest("s")).collect())
    assert a == b != c


def test_vectors(spark):
    row = spark.range(1).select(vectors.argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("first"), vectors.kl(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("same"), vectors.normalised(F.array(F.lit(-1.0), F.lit(0.0))).alias("none"), vectors.ranked_probability_score(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("rps")).first()
    assert row["first"] == 0 and abs(row["same"]) < 1e-12 and row["none"] is None and abs(row["rps"] - 1) < 1e-12


def test_middle_cut_keeps_short_texts(spark):
    df = spark.createDataFrame([(["a"] * 4,), ([*"abcdef"],)], "w array<string>")
    assert [r[0] for r in df.select(examples.middle_cut(F.col("w"), 4)).collect()] == ["a a a a", "a b\n[...]\ne f"]


def test_round_robin_balances(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(100)], "id long, c string").withColumn("g", F.lit(1))
    counts = {r["c"]: r["count"] for r in selection.round_robin(df, ["g"], "c", 15, 1, "id").groupBy("c").count().collect()}
    assert counts == {"a": 8, "b": 7} or counts == {"a": 7, "b": 8}


def test_sources_and_sinks(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r["x"] for r in readers.json_lines(spark, str(tmp_path / "a.jsonl.gz"), "x int").collect()) == [1, 2]
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 3}]))
    assert readers.json_array(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "a.csv").write_text('x,y\n1,"a ""b""\nc"\n')
    assert readers.csv(spark, str(tmp_path / "a.csv")).first()["y"] == 'a "b"\nc'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.json", "{}")
        z.writestr("n.txt", "")
    assert [r["member"] for r in readers.zip_members(spark, str(tmp_path / "a.zip")).collect()] == ["m.json"]
    df = spark.createDataFrame([(i, "tv"[i % 5 == 0]) for i in range(20)], "id long, split string")
    write_splits(df, str(tmp_path / "out"), "split", 1)
    assert spark.read.json(str(tmp_path / "out")).count() == 20
    write_manifest(df, str(tmp_path / "manifest"), ["split"], 1, ["none"])
    assert spark.read.json(str(tmp_path / "manifest")).first()["table"]["n"] == 20
    done = spark.createDataFrame([(1, 200), (2, 500)], "id long, status int")
    assert readers.pending(df, done, "id", F.col("status") == 200).count() == 19


def test_distractors_draw_without_return(spark):
    rows = spark.createDataFrame([(i, f"c{i % 12}") for i in range(600)] + [(600, None), (601, "not there")], "id long, gold string")
    catalog = spark.createDataFrame([(f"c{i % 12}",) for i in range(40)] + [(None,)], "c string")
    got = {}
    for r in examples.distractors(rows, catalog, "c", "gold", "id", 5, 1).collect():
        got.setdefault(r["id"], []).append(r["c"])
    assert len(got) == 602 and all(len(v) == len(set(v)) == 5 for v in got.values())
    assert all(f"c{i % 12}" not in got[i] for i in range(600))
    times = [sum(f"c{c}" in v for v in got.values()) for c in range(12)]
    assert min(times) > 200 and max(times) < 300  # 250 each
    few = examples.distractors(rows, catalog.where("c IN ('c1', 'c2')"), "c", "gold", "id", 5, 1).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in few} == {i: 1 if i < 600 and i % 12 in (1, 2) else 2 for i in range(602)}
    assert examples.distractors(rows, catalog.where("c = 'x'"), "c", "gold", "id", 5, 1).count() == 0


def test_percentiles_match_numpy(spark):
    import numpy as np

    from quaestor.operators.ordered import percentiles

    draw = np.random.default_rng(3)
    data = [(g, float(v)) for g in ("a", "b", None) for v in draw.integers(0, 40, 300)] + [("one", 2.5), ("none", None)]
    rows = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r["p"] for r in percentiles(rows, "g", "v", [0.0, 0.37, 0.5, 1.0]).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, p in got.items():
        assert np.allclose(p, np.quantile([v for h, v in data if h == g], [0.0, 0.37, 0.5, 1.0]))


def test_round_robin_of_a_hot_class(spark):
    from quaestor.operators.selection import round_robin

    rows = spark.range(5000).selectExpr("id", "0 AS w", "CASE WHEN id % 50 = 0 THEN id % 3 ELSE 7 END AS c")
    got = [r["c"] for r in round_robin(rows, ["w"], "c", 60, 1, "id").collect()]
    assert {c: got.count(c) for c in set(got)} == {0: 15, 1: 15, 2: 15, 7: 15}


def test_reuse_fails_where_something_is_missing(spark):
    from quaestor.operators.requests import checked_lookup, reused
    from quaestor.operators.manifest import fingerprint

    earlier = spark.createDataFrame([(1, "p", "ok", 0.5), (2, "p", "failed", 0.1)], "id long, payload string, status string, answer double")
    ask = lambda i, p: reused(spark.createDataFrame([(i, p)], "id long, payload string"), earlier, "id", "payload", "status", "ok", "answer").collect()
    assert ask(1, "p")[0]["answer"] == 0.5
    for i, p, why in ((1, "q", "another payload"), (2, "p", "failed"), (3, "p", "missing")):
        with pytest.raises(Exception, match=why):
            ask(i, p)
    train = spark.createDataFrame([(1, "x")], "id long, t string")
    noted = tuple(fingerprint(train, train.columns).first())
    found = earlier.select("id", "answer")
    assert checked_lookup(train, found, "id", "answer", train, noted).count() == 1
    with pytest.raises(ValueError, match="other rows"):
        checked_lookup(train, found, "id", "answer", spark.createDataFrame([(1, "y")], "id long, t string"), noted)


def test_cover_takes_strata_then_one_special_row(spark):
    from quaestor.operators.selection import cover

    rows = spark.range(60).selectExpr("id", "id % 5 AS s", "id >= 50 AS special", "concat('h', lpad(id, 3, '0')) AS h")
    got = [r["id"] for r in cover(rows, "s", rows["special"], ["h"], "id", 8).orderBy("h").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 50]



def test_leaf_strings_of_any_depth(spark):
    from pyspark.sql import functions as F

    from quaestor.functions import keys as K

    states = ['{"a": ["he said \\"x\\": ok\\\\", ["two", 3]], "b": {"c": "three: \\n", "": null}}', '"alone"', "[]", "7"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(states)], "i int, j string").orderBy("i").select(K.leaf_strings("j")).collect()]
    assert got == [['he said "x": ok\\', "two", "three: \n"], ["alone"], [], []]


def test_counts_and_lookups_that_fail_the_job(spark):
    from quaestor.operators import requests as R

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, k int")
    with pytest.raises(Exception, match="too few rows in b"):
        R.at_least(rows, "g", 2).collect()
    with pytest.raises(Exception, match="too few rows in b"):
        R.quota(rows, "g", 2, "k").collect()
    found = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    with pytest.raises(Exception, match="no value for 3"):
        R.total_lookup(rows, found, "k", "v").collect()
    assert [r["v"] for r in R.total_lookup(rows.where("k < 3"), found, "k", "v").orderBy("k").collect()] == ["x", None]


def test_nested_json_files_and_their_lists(spark, tmp_path):
    import json

    from quaestor.sources import readers

    for k in range(2):
        (tmp_path / f"d{k}.json").write_text(json.dumps([{"id": k, "turns": [{"say": "a", "frames": [1, 2]}, {"say": "b", "frames": [3]}]}]))
    got = readers.nested_json(spark, f"{tmp_path}/*.json", "id int, turns array<struct<say: string, frames: array<int>>>", "turns", "turns_one.frames")
    assert sorted((r["id"], r["turns_at"], r["frames_at"], r["frames_one"]) for r in got.collect()) == [(k, *x) for k in range(2) for x in ((0, 0, 1), (0, 1, 2), (1, 0, 3))]


def test_a_cluster_needs_a_shared_folder():
    from quaestor.sources import session

    class Fake:
        class sparkContext:
            master = "spark://h:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())


def test_tool_calls_of_odd_rows(spark):
    from quaestor.operators.adapters import tool_calls

    chat = lambda user, said: f"USER: {user}\n\nASSISTANT: {said}<|endoftext|>\n\n"
    rows = [
        (1, chat("a", '<functioncall> {"name": "f"}'), 'x {"name": "f"}{"name": "g", "p": {"q": "}{"}}'),
        (2, chat("a", '<functioncall> {"name": "h"}'), '{"name": "f"}'),
        (3, chat("a", "I cannot help."), '{"name": "f"}'),
        (4, chat("a", "I cannot help."), '{"name": "f"} {"name": "f"}'),
        (5, chat("a", "I cannot help."), '{"name": "f"} and more'),
        (6, chat("a" * 1801, "I cannot help."), '{"name": "f"}'),
        (7, None, '{"name": "f"}'),
        (8, chat("a", "I cannot help."), None),
        (9, chat("", "Yes."), '{"name": "f"}'),
    ]
    got = tool_calls(spark.createDataFrame(rows, "id int, chat string, system string"), "chat", "system").collect()
    assert sorted((r["id"], r["user"], r["tools"], r["called"]) for r in got) == [(1, "a", ["f", "g"], "f"), (3, "a", ["f"], None)]


def test_rule_trees_against_a_plain_evaluator(spark):
    import random

    from pyspark.sql import functions as F

    from quaestor.operators import trees

    rng = random.Random(4)

    def grown(depth):
        if depth == 0 or rng.random() < 0.2:
            return [str(rng.randrange(4))]
        op = rng.choice(list(trees.ARITY))
        return [t for _ in range(trees.ARITY[op]) for t in grown(depth - 1)] + [op]

    def plain(tokens, facts):
        stack = []
        for t in tokens:
            if t.isdigit():
                stack.append(facts[int(t)])
                continue
            args = [stack.pop() for _ in range(trees.ARITY[t])][::-1]
            stack.append({"not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "if": lambda a, b, c: b if a else c}[t](*args))
        return stack[0]

    rows = [(grown(4), [rng.random() < 0.5 for _ in range(4)]) for _ in range(200)]
    got = spark.createDataFrame(rows, "t array<string>, f array<boolean>").select("t", "f", trees.truth(F.col("t"), F.col("f")).alias("x"), trees.leaves(F.col("t")).alias("l")).collect()
    assert all(r["x"] == plain(r["t"], r["f"]) and r["l"] == sorted({int(t) for t in r["t"] if t.isdigit()}) for r in got)
