"""The training-data operators against plain versions, and on null, empty, repeated and clashing rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quaestor.llm import ann, bpe, classifier, jaccard_join, packing, para_dedup, quality_rules, sharding, token_counts, tokens, wavelet  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, k long, token string, `_text` string, kept string"


def documents():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["an", "the", "or", "ti", "É", "ß", "q", "ing"]) for _ in range(rnd.randint(1, 4)))
    texts = [" ".join(word() + rnd.choice(["", "", ".", ",", ".\n"]) for _ in range(rnd.choice([3, 60, 200]))) for _ in range(60)]
    texts += [texts[1]] * 5 + [texts[2] + " more", None, "", "", " \n\t ", "x<|endoftext|>y  <|startoftext|> ", "日本 語 é", "\x1c a\x85b", "word " * 4000, "### $$$ " * 40, "z" * 3000]
    passage = " ".join(word() for _ in range(70))
    texts += [texts[3] + " " + passage + " tail", "head " + passage + "\n" + texts[4]]
    out = [(i, t, "en" if i % 3 else None, "hot" if i % 2 else "s", 0, 1, 2, "t", "u", "v") for i, t in enumerate(texts)]
    return out + out[:1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return [(r[0], r[1] or "") for r in documents()]


def ids_of(lib, text):
    return np.array(lib.encode(text, add_special_tokens=False).ids, dtype="<u4")


def test_encoders_are_exact(texts):
    for path in (BYTE, WORD):
        lib = Tokenizer.from_file(path)
        assert tokens.encode_texts(path, [t for _, t in texts]) == [ids_of(lib, t).tobytes() for _, t in texts]


def test_packing(docs, empty, texts):
    lib, rows = Tokenizer.from_file(BYTE), packing.pack(docs, BYTE).collect()
    want = Counter(zlib.crc32(np.append(ids_of(lib, t), np.uint32(1)).astype("<u4").tobytes()) for _, t in texts)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids_of(lib, t)) + 1 for _, t in texts) and want
    whole = {d: np.append(ids_of(lib, t), np.uint32(1)).astype("<u4") for d, t in texts}
    for r in rows:
        assert zlib.crc32(whole[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(whole[r["doc_id"]])
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(empty, BYTE).count() == 0


def test_fill_is_the_best_sum():
    rnd = random.Random(1)
    for _ in range(200):
        items, cap = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 9))], rnd.randint(1, 60)
        got = packing.fill(dict(Counter(items)), cap)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= cap}
        assert sum(n * c for n, c in got.items()) == max(sums) and all(c <= Counter(items)[n] for n, c in got.items())


def test_token_counts(docs, empty, texts):
    lib, by = Tokenizer.from_file(BYTE), dict(texts)
    for r in token_counts.token_counts(docs, BYTE, limit=100).collect():
        t = by[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), len(ids_of(lib, t)), len(ids_of(lib, t)) > 100)
        assert len(ids_of(lib, t[: r["limit_chars"]])) <= 100
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_every_prefix_count():
    table, lib = token_counts.Prefixes(tokens.load(BYTE)), Tokenizer.from_file(BYTE)
    for word in (" unbelievable", "thanatory", " ingountionly", "aaaaaaa", "123456"):
        assert table.counts(word) == [len(ids_of(lib, word[:i])) for i in range(len(word) + 1)]


def test_wavelet_files(spark, docs, empty, texts, tmp_path):
    lib = Tokenizer.from_file(WORD)
    wavelet.write_shards(docs, str(tmp_path / "f"), WORD, shard=500)
    rows, at = sorted(wavelet.read_shards(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"]), 0
    order = sorted(texts)
    assert len(rows) == len(order)
    for r, (d, t) in zip(rows, order):
        ids = np.append(ids_of(lib, t), np.uint32(1)).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert wavelet.token_files(empty, WORD).count() == 0


def test_wavelet_access_rank_select():
    ids = np.random.default_rng(2).integers(0, 40, size=5000).astype("<u4")
    shard = wavelet.Shard(wavelet.build([1, None], [2000, 3000], ids))
    assert (shard.tokens() == ids).all() and shard.doc_ids == [1, None]
    assert [shard.access(i) for i in range(0, 5000, 97)] == ids[::97].tolist()
    assert shard.rank(7, 3000) == int((ids[:3000] == 7).sum()) and shard.count(999) == 0
    assert shard.occurrences(3) == np.flatnonzero(ids == 3).tolist()


def plain_rules(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_rules(docs, empty, texts):
    by, rows = dict(texts), quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = plain_rules(by[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["base_failed"] and r["kept"])
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.filter_documents(empty).count() == 0


def test_sharding(docs, empty, texts):
    rows = sharding.shard(docs, n_shards=7).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and max(map(len, by.values())) - min(len(by[s]) for s in range(7)) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts)
    assert sharding.shard(empty, n_shards=7).count() == 0


def test_bpe(docs, empty, texts):
    lib, by = Tokenizer.from_file(WORD), dict(texts)
    for r in bpe.bpe_digests(docs, WORD).collect():
        ids = ids_of(lib, by[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digests(empty, WORD).count() == 0


def plain_components(texts, n, percent):
    sets = {}
    for d, t in texts:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 30)])
def test_jaccard_join(spark, docs, texts, n, percent):
    want = plain_components(texts, n, percent)
    got = jaccard_join.join(docs, n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(texts)


def test_jaccard_join_of_a_dense_group(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(base) if rnd.random() < 0.03 else w for w in base)) for i in range(120)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70).collect()}
    assert got == plain_components(rows, 3, 70)


def test_jaccard_without_rows(empty):
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.deduplicate(empty).columns == empty.columns


def test_classifier(spark, docs, empty):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["river", "stone", "walks", "under", "light", "slowly"]) + rnd.choice(["", ".", ","]) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["###", "$$$ x", "BUY!!", "&&&"]) for _ in range(80))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = classifier.classify(data, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], int(r["doc_id"] % 4 > 0)) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert classifier.classify(docs, labels).count() == docs.count() and classifier.keep(docs, labels).columns == docs.columns
    assert classifier.classify(empty, labels).count() == 0 and classifier.classify(docs, labels.limit(0)).count() == docs.count()


def test_isotonic_is_monotone():
    x = np.array([3.0, 1, 2, 2, 5, 4])
    knots, values = classifier.isotonic(x, np.array([1.0, 0, 1, 0, 1, 0]))
    assert (np.diff(values) >= -1e-12).all() and (np.diff(knots) > 0).all()


def test_substring_dedup(spark, docs, empty):
    cleaned = para_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    kept = [r["text"] for r in cleaned.collect() if r["text"]]
    seen: dict = {}
    for t in {*kept}:
        w = t.lower().split()
        if len(set(w)) < 10:
            continue
        for i in range(len(w) - 51):
            assert seen.setdefault(tuple(w[i : i + 52]), t) == t
    assert para_dedup.report(empty).count() == 0 and para_dedup.clean(empty).count() == 0


def test_embedded_passage_is_cut_where_it_repeats(spark):
    rnd = random.Random(8)
    words = lambda k, n: " ".join(f"{k}{rnd.randrange(10**6)}" for _ in range(n))
    passage = words("p", 60)
    rows = [(1, words("a", 30) + " " + passage + " " + words("b", 20)), (2, words("c", 90)), (3, words("d", 7) + "\n" + passage + "\n" + words("e", 8))]
    got = para_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["kept_doc_id"], rows[2][1][r["start"] : r["stop"]]) for r in got] == [(3, 1, passage)]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[50:70] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [1.0]), (1004, [None] + [1.0] * 15)]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        scores = np.einsum("d,nd->n", x[q], x)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - scores[i]) < 1e-9 for _, i, s in found)
        hits += len({f[1] for f in found} & set(want))
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_chi_square():
    assert abs(ann.chi_square(np.array([5.348]), 6)[0] - 0.5) < 1e-3


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert all(sum(p[1] for p in v) % v[0][2] == 0 for v in by.values())


def plain_gone(rows, words=50, n=5, percent=80, passages=True):
    """The words that go from each text: lines of a group but the least one, and passages that a lesser document holds."""
    lines, gone = [], defaultdict(set)
    for d, t in rows:
        at = 0
        for k, line in enumerate(t.split("\n")):
            w = line.split()
            if len(w) >= words:
                lines.append(((d, k), {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, range(at, at + len(w))))
            at += len(w)
    root = {x[0]: x[0] for x in lines}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, (a, x, _) in enumerate(lines):
        for b, y, _ in lines[:i]:
            if a[0] != b[0] and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    for a, _, span in lines:
        if find(a) != a:
            gone[a[0]].update(span)
    seen: set = set()
    for d, t in sorted(rows) if passages else []:
        w = t.split()
        runs = [tuple(w[i : i + words]) for i in range(len(w) - words + 1)]
        for i, run in enumerate(runs):
            if run in seen:
                gone[d].update(range(i, i + words))
        seen.update(runs)
    return {d: v for d, v in gone.items() if v}


def reported_gone(spark, rows, kinds=("paragraph", "passage")):
    by, gone = dict(rows), defaultdict(set)
    for r in para_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        if r["kind"] in kinds:
            first = len(by[r["doc_id"]][: r["start"]].split())
            gone[r["doc_id"]].update(range(first, first + len(by[r["doc_id"]][r["start"] : r["stop"]].split())))
    return dict(gone)


def test_near_lines_beside_an_unlike_least_one(spark, monkeypatch):
    rnd = random.Random(12)
    base = [f"t{i}" for i in range(120)]
    variant = lambda words, share: [f"x{rnd.randrange(10**9)}" if rnd.random() < share else w for w in words]
    rows = []
    for k in range(40):
        one = variant(base, 0.05)
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(variant(one, 0.012)))]
    twice = " ".join(variant(base, 0.05))
    rows += [(200, twice + "\n" + twice), (201, twice)]
    monkeypatch.setattr(para_dedup, "BLOCK", 1 << 14, raising=False)
    gone, want = reported_gone(spark, rows, ["paragraph"]), plain_gone(rows, passages=False)
    # a band misses some pairs, so the links that count are those of lines that share one
    keys = {d: set(para_dedup.band_keys(para_dedup.S.word_hashes(t)).tolist()) for d, t in rows[:80]}
    assert all(keys[2 * k] & keys[2 * k + 1] for k in range(40) if 2 * k + 1 in want)
    assert gone == want


def test_passages_that_the_least_document_holds_in_part(spark):
    rnd = random.Random(13)
    words = lambda k, n: [f"{k}{rnd.randrange(10**9)}" for _ in range(n)]
    rows, d = [], 0
    for k in range(25):
        p, short = words("p", rnd.choice([50, 55, 60, 90])), rnd.randrange(24, 50)
        cut = rnd.randrange(len(p) - short + 1)
        part = p[cut : cut + short]
        rows.append((d, words("a", 5) + part + words("b", rnd.randrange(40)) + (p if k % 3 == 0 else part)))
        rows.append((d + 1, words("c", 9) + p[: max(50, len(p) - 10)] + words("d", 3)))
        rows += [(d + i, words("e", i) + p + words("f", 30)) for i in (2, 3)]
        d += 4
    period = words("q", 20)
    rows += [(d, words("g", 3) + (period * 4)[7:62]), (d + 1, (period * 4)[:57] + words("h", 9)), (d + 2, ["w"] * 300), (d + 3, ["v"] + ["w"] * 170 + ["v"])]
    # in one line each, of which none is like another
    rows = [(i, " ".join(w[:40]) + "\n" + "\n".join(" ".join(w[j : j + 40]) for j in range(40, len(w), 40))) for i, w in rows]
    assert reported_gone(spark, rows) == plain_gone(rows)
