"""Versions, retries, manifests, early-stopping scans, JSON states, call literals and answers by state."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quaestor.functions import keys as K
from quaestor.functions import vectors as V
from quaestor.operators import manifest, prompts, scoring, sinks, versions
from quaestor.operators.adapters import tool_calls
from quaestor.sources.scan import QuotaScan


def test_readers_see_whole_versions_wherever_a_writer_stops(spark, tmp_path):
    path, rows = str(tmp_path / "status"), lambda n: spark.range(n).repartition(3)
    seen = lambda: versions.read(spark, path, "id long").count()
    assert seen() == 0
    versions.write_version(rows(5), path)  # stopped before the commit
    assert seen() == 0
    for n in (7, 9, 11, 13):
        before = seen()
        v = versions.write_version(rows(n), path)
        assert seen() == before
        versions.commit(spark, path, v)
        assert seen() == n
        old = versions.read(spark, path, "id long")
        versions.clean(spark, path)
        assert seen() == n
    assert versions.versions(spark, path) == [4, 5] and versions.versions(spark, path, committed=False) == [4, 5]
    versions.replace(rows(1), path)
    assert old.count() == 13 and seen() == 1  # who began with the version before still reads it
    with pytest.raises(Exception, match="exist"):
        versions.commit(spark, path, 6)


def test_failed_keys_are_asked_again_and_the_last_attempt_wins(spark, tmp_path):
    planned, path, fine, asked = spark.range(6), str(tmp_path / "r"), F.col("status") == "ok", []

    def solve(bad):
        def run(rows):
            asked.append(sorted(r["id"] for r in rows.collect()))
            return rows.select("id", F.when(F.col("id").isin(bad), "failed").otherwise("ok").alias("status"))

        return run

    sinks.append_results(planned.where("id < 4"), path, "id", solve([1, 2]), fine)
    sinks.append_results(planned, path, "id", solve([2]), fine)
    got = sinks.append_results(planned, path, "id", solve([]), fine)
    assert asked == [[0, 1, 2, 3], [1, 2, 4, 5], [2]]
    assert {r["id"]: (r["status"], r["attempt"]) for r in got.collect()} == {0: ("ok", 1), 1: ("ok", 2), 2: ("ok", 3), 3: ("ok", 1), 4: ("ok", 2), 5: ("ok", 2)}


def test_a_changed_byte_is_named(spark, tmp_path):
    path = str(tmp_path / "out")
    manifest.write_splits(spark.createDataFrame([(i, "tv"[i % 5 == 0]) for i in range(200)], "id long, split string"), path, "split", 1)
    facts = manifest.file_manifest(spark.read.schema("id long").json(path), path)
    saved = spark.createDataFrame(facts.collect(), facts.schema)
    files = sorted(f for f in (tmp_path / "out").rglob("*.json"))
    want = {str(f.relative_to(path)): (len(f.read_text().splitlines()), f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files}
    got = {r["file"]: (r["rows"], r["bytes"], r["sha256"]) for r in saved.collect()}
    assert {k: v for k, v in got.items() if k in want} == want and sum(v[0] for v in got.values()) == 200
    assert manifest.changed_files(spark, path, saved).count() == 0
    files[0].write_bytes(files[0].read_bytes().replace(b'"id":', b'"iD":', 1))
    (files[0].parent / f".{files[0].name}.crc").unlink()  # what the local file system would notice by itself
    files[1].unlink()
    (files[0].parent / "part-new.json").write_text("{}\n")
    changed = {r["file"]: r["kind"] for r in manifest.changed_files(spark, path, saved).collect()}
    new = str((files[0].parent / "part-new.json").relative_to(path))
    assert changed == {str(files[0].relative_to(path)): "changed", str(files[1].relative_to(path)): "missing", new: "new"}


def test_a_scan_stops_when_quotas_are_full(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.range(3000).selectExpr("id", "id % 30 AS part", "CASE WHEN id % 7 = 0 THEN 'a' WHEN id % 2 = 0 THEN 'b' ELSE 'c' END AS cls", "id % 3 AS k")
    df.repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(path)
    scan = QuotaScan(spark, path, "id long, cls string, k long", "cls", {"a": 20, "b": 30}, 4, F.col("k") > 0, name=lambda f: f.split("/")[0])
    order = sorted(range(30), key=lambda p: hashlib.sha256(f"4|part={p}".encode()).hexdigest())
    want, left = [], {"a": 20, "b": 30}
    for n, p in enumerate(order):
        for i in range(p, 3000, 30):
            cls = "a" if i % 7 == 0 else "b" if i % 2 == 0 else "c"
            if i % 3 and left.get(cls):
                left[cls] -= 1
                want.append((i, cls, n))
    assert sorted((r["id"], r["cls"], r["file_no"]) for r in scan.rows().collect()) == sorted(want)
    last = max(n for _, _, n in want)
    assert last < len(scan.files) <= 2 * last + 1 and len(scan.files) < 30
    assert [f.split("/")[0] for f in scan.files] == [f"part={p}" for p in order[: len(scan.files)]]
    whole = QuotaScan(spark, path, "id long, cls string, k long", "cls", {"a": 10**6}, 4)
    assert whole.rows().count() == len(range(0, 3000, 7)) and len(whole.files) == 30
    assert QuotaScan(spark, path, "id long, cls string, k long", "cls", {"x": 1}, 4).rows().count() == 0


def test_texts_that_are_no_json_have_keys(spark):
    rows = ['{"a": 1, "b": "long enough to be an atom, at thirty-two"}', '{"b":"long enough to be an atom, at thirty-two","a":1}', '{"a": 1', "plain  Text", "plain text", '{"a": 1, "a": 2}', None, ""]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, s string").select("i", K.state_key("s", F.lit("json")).alias("k"), K.leaf_strings("s").alias("l"), F.size(K.leaf_atoms("s")).alias("n")).orderBy("i").collect()
    k = [r["k"] for r in got]
    assert k[0] == k[1] and k[3] == k[4] and len({*k[:4], k[5], k[7]}) == 5 and k[6] is None
    assert [r["l"] for r in got][2:] == [['{"a": 1'], ["plain  Text"], ["plain text"], ['{"a": 1, "a": 2}'], None, [""]] and got[0]["n"] == 1


def test_states_are_indented_as_they_are(spark):
    values = [{"b": {"é": [1, [], {}, [{"x": None}]]}, "a": "q\"\\\n\t\x0b"}, {}, [], ["one", "two\nlines"], ["one", 2], "text", 7, True, None, {"n": 1.5e10, "big": 12345678901234567890}]
    rows = [json.dumps(v, ensure_ascii=i % 2 == 0) for i, v in enumerate(values)] + ["{torn", "", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, s string").orderBy("i").select(prompts.state_text("s")).collect()]
    shown = lambda v: v if isinstance(v, str) else "\n\n".join(v) if isinstance(v, list) and all(isinstance(x, str) for x in v) else json.dumps(v, ensure_ascii=False, indent=2)
    assert got == [*map(shown, values), "{torn", "", None]


def test_options_without_descriptions_stay(spark):
    rows = spark.sql("SELECT array(struct('a' AS key, 'first' AS desc), struct('b' AS key, NULL AS desc), struct('c' AS key, 'third' AS desc)) AS o")
    text = rows.select(prompts.user_prompt(F.lit("choice"), F.lit("s"), F.lit("q"), F.col("o"))).first()[0]
    assert "A: a: first\nB: b: b\nC: c: third\n" in text and text.endswith("(A-C).")
    levels = rows.select(prompts.user_prompt(F.lit("score"), F.lit("s"), F.lit("q"), F.col("o"))).first()[0]
    assert "0: first\n1: b\n2: third\n" in levels


def test_calls_as_literals(spark):
    said = {
        "{'name': 'f', 'arguments': '{\"x\": 1}'}": ("f", '{"x": 1}'),
        "{\"name\": \"f\", 'arguments': {'x': [1, -2.5, (3,), None, True], \"it's\": 'é\\n'}}": ("f", '{"x": [1, -2.5, [3], null, true], "it\'s": "é\\n"}'),
        "{'name': 'f'}": ("f", None),
        "{'name': 'f', 'arg": None,
        "{'name': 'f'} and more": None,
        "{'name': f}": None,
        "__import__('os')": None,
        "['f']": None,
        "{'name': 3}": None,
        "{'name': 'f', 'arguments': " + "[" * 500 + "}": None,
    }
    rows = [(i, f"USER: u\n\nASSISTANT: <functioncall> {s} <|endoftext|>", '{"name": "f"}') for i, s in enumerate(said)]
    rows += [(90, "USER: u\n\nASSISTANT: I cannot help", '{"name": "f"}'), (91, "ASSISTANT: I cannot help.\n\n", '{"name": "f"}'), (92, "USER: u ASSISTANT: I cannot help.\n\n", '{"name": "f"}'), (93, "x USER:  u\nASSISTANT:\n\n I cannot help.\n\nUSER: v", '{"name": "f"}')]
    got = {r["id"]: (r["called"], r["arguments"]) for r in tool_calls(spark.createDataFrame(rows, "id int, chat string, system string"), "chat", "system").collect()}
    assert got == {i: v for i, v in enumerate(said.values()) if v} | {93: (None, None)}


def test_a_state_is_prepared_once_for_all_its_questions(spark, tmp_path):
    place = str(tmp_path)

    def prepare(state):
        import uuid
        from pathlib import Path

        Path(place, uuid.uuid4().hex).write_text(state)
        return len(state)

    def score(size, questions, counts):
        return [[float(size % (j + 2)) for j in range(n)] for n in counts]

    rows = [(i, f"state {'x' * (i % 4)}", f"q{j}", f"what {j}?", [f"o{k}" for k in range(j + 1)]) for i in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "request_id long, state string, name string, question string, keys array<string>").repartition(5)
    got = scoring.answered(df, prepare, score).collect()
    assert Counter(f.read_text() for f in tmp_path.iterdir()) == {f"state {'x' * k}": 1 for k in range(4)}
    assert {(r["request_id"], r["name"]) for r in got} == {(r[0], r[2]) for r in rows} and len(got) == len(rows)
    for r in got:
        n = int(r["name"][1:]) + 1
        assert list(r["raw"]) == score(6 + r["request_id"] % 4, [""], [n])[0] and len(r["probabilities"]) == n
        assert abs(sum(r["probabilities"].values()) - 1) < 1e-9 and r["confidence"] == r["probabilities"][r["choice"]] == max(r["probabilities"].values())
    with pytest.raises(Exception, match="1 options and logits"):
        scoring.answered(df, len, lambda s, q, c: [[1.0, 2.0] for _ in c]).collect()
    with pytest.raises(Exception, match="logits"):
        scoring.answered(df, len, lambda s, q, c: [[float("nan")] * n for n in c]).collect()


def test_divergence_from_a_teacher(spark):
    import math

    z, t = [0.3, -1.0, 2.0], [1.0, 0.0, -0.5]
    soft = lambda x: [math.exp(v / 2) / sum(math.exp(w / 2) for w in x) for v in x]
    want = 4 * sum(b * math.log(b / a) for a, b in zip(soft(z), soft(t)))
    df = spark.createDataFrame([(z, t)], "z array<double>, t array<double>")
    got = df.select(V.teacher_kl("z", "t"), V.teacher_kl("z", "z")).first()
    assert abs(got[0] - want) < 1e-9 and abs(got[1]) < 1e-12
