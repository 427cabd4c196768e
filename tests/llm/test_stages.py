"""A run of the pipeline against plain versions of its stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")
from test_llm import BYTE, ids_of, plain_components, plain_gone  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quaestor.llm import classifier, quality_rules  # noqa: E402


def test_a_run_keeps_and_cuts_what_plain_stages_do(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(31)
    vocabulary = [f"{a}{b}{c}" for a in ("sto", "ri", "wal", "un", "li", "mo") for b in ("ne", "ver", "king", "der") for c in ("", "s", "ly", "ed")]
    line = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", "."]) for _ in range(n))
    prose = lambda: [line(rnd.randint(9, 14)) for _ in range(rnd.randint(7, 12))]
    junk = lambda: [" ".join(rnd.choice(["###", "$$$ BUY", "&&", "x"]) for _ in range(12)) for _ in range(8)]
    passage, texts, bad = line(60), [], []
    for i in range(240):
        lines = junk() if i % 5 == 4 else prose()
        of = i - 7 if i > 10 and i % 12 in (7, 9) else i
        bad.append(bad[of] if of < i else i % 5 == 4)
        if i in (20, 33, 70):
            lines.insert(3, passage)
        if i % 12 == 7 and i > 10:
            lines = [*texts[i - 7][:-1], line(3)]
        if i % 12 == 9 and i > 10:
            lines = texts[i - 7]
        if i == 100:
            lines = ["##### " * 30, *lines]
        texts.append(lines)
    rows = [(i, "\n".join(x), ["en", "de"][i % 2], "hot" if i % 3 else "cold", 0) for i, x in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "hot", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(not bad[i])) for i in range(240)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    scored = classifier.classify(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    kept = {r["doc_id"] for r in scored if r["predicted"]}
    assert {i for i in range(240) if not bad[i]} <= kept and not any(bad[i] for i in kept if i < 240)
    left = [r for r in rows if r[0] in kept]
    spark.createDataFrame(left, docs.schema).coalesce(1).write.parquet(str(tmp_path / "left"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/left/*.parquet')")
    fine = {r[0] for r in con.execute(quality_rules.ORACLE).fetchall() if r[-1]}
    left = [(r[0], r[1]) for r in left if r[0] in fine]
    found = plain_components(left, 5, 80)
    assert any(found[d][1] != d for d, _ in left)
    left = [(d, t) for d, t in left if found[d][1] == d]
    gone, want, lib = plain_gone(left), {}, Tokenizer.from_file(BYTE)
    assert gone
    for d, t in left:
        at, lines = 0, []
        for x in t.split("\n"):
            n = len(x.split())
            cut = gone.get(d, set()) & set(range(at, at + n))
            assert len(cut) in (0, n)
            lines += [] if cut else [x]
            at += n
        want[d] = np.append(ids_of(lib, "\n".join(lines)), 1).astype("<u4")

    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert sorted(pieces) == sorted(want)
    for d, own in pieces.items():
        at = 0
        for start, n, crc, total in sorted(own):
            assert start == at and total == len(want[d]) and crc == zlib.crc32(want[d][at : at + n].tobytes())
            at += n
        assert at == len(want[d])
