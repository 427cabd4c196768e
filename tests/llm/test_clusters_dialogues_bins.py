"""Centroid clustering, repair of conversations and best-fit packing against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")
from tokenizers import Tokenizer  # noqa: E402

from quaestor.llm import bins, centroids, dialogue_repair  # noqa: E402
from quaestor.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = public_tokenizers.path("word_bpe_49k.json")


# centroids


def plain_clusters(rows, k, rounds):
    """(vec_id, cluster, distance) in whole numbers, one pair at a time."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (named(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centres)]
    return [(i, near(v)[1], near(v)[0], tuple(centres[near(v)[1]])) for i, v in kept]


def vectors():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(5, 64))
    rows = [(i, (middle[i % 5] + 0.1 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [rows[7], (7, rows[8][1]), (None, rows[1][1]), (None, rows[2][1])]
    bad = rows[0][1]
    return rows + [(300, None), (301, bad[:63]), (302, [None, *bad[1:]]), (303, [float("nan"), *bad[1:]]), (304, [float("inf"), *bad[1:]]), (305, []), (306, [0.0] * 64), (307, [1000.0, *[-0.001] * 63])]


@pytest.mark.parametrize("k", [6, 40, 400])
def test_clusters_are_those_of_whole_numbers(spark, k):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int").repartition(3)
    got = centroids.cluster(df, k=k).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"], tuple(r["centroid"])) for r in got) == Counter(plain_clusters(rows, k, 5))
    total = centroids.inertia(centroids.cluster(df, k=k)).collect()
    by = defaultdict(int)
    for r in got:
        by[r["cluster"]] += r["distance"]
    digest = {r["cluster"]: hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest() for r in got}
    assert all(r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values()) and r["centroid_sha256"] == digest[r["cluster"]] for r in total) and len(total) == len(got)


def test_no_vectors_no_clusters(spark):
    empty = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert centroids.inertia(centroids.cluster(empty)).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="would not fit in a long"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_bounds_never_pass_distances_and_spare_most():
    rng = np.random.default_rng(9)
    for size in (3, 200, 1 << 26):
        v, c = rng.integers(-size, size, (300, 64)), rng.integers(-size, size, (40, 64))
        small = centroids.compress(v)
        want = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v[:20]])
        assert (centroids.lower_bounds(small.rows(0, 20), c) <= want).all()
        to, distance, asked = centroids.nearest(v, small, c)
        assert (to[:20] == want.argmin(1)).all() and (distance[:20] == want.min(1)).all()
    v = rng.integers(-200, 200, (40, 64)).repeat(50, 0) + rng.integers(-20, 20, (2000, 64))
    assert centroids.nearest(v, centroids.compress(v), v[::50])[2] < 0.1 * 2000 * 40  # of clustered vectors, two a vector


# conversations

SOLID = re.compile("[^\x20\x09-\x0d]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_audit(rows):
    """Of one conversation's rows: the least (cost, audit) by a search over (row, roles so far), and the rest."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    grammar, begun = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and grammar.fullmatch(roles):
            break
        if (at, roles) in done or not begun.fullmatch(roles):
            continue
        done.add((at, roles))
        for new in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, roles + new[0], (*lines, f"{new}:")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, roles + new[0], (*lines, f"{new}:{text}")))
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(n=150):
    rnd = random.Random(12)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "System", "u"]
    texts = ["Fine.", "So?", "cut", "Yes! ", " \t\n", None, "", "x" * 5000 + ".", "ends.\x0b", "né.", "\x1c"]
    rows = [(c, rnd.choice([t, t, t, None, 3]), rnd.choice(roles), rnd.choice(texts)) for c in [*range(n), None] for t in range(rnd.randint(1, 7))]
    return rows + [rows[4], rows[4], (n, None, "user", "Hm.")]


def test_audits_are_the_cheapest_and_least(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, kind int, fault string").repartition(3).write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    want = Counter((c, *plain_audit(v)) for c, v in by.items())
    got = dialogue_repair.audits(dialogue_repair.damage(df), "present")
    assert Counter(tuple(r) for r in got.collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    assert Counter(con.execute(dialogue_repair.ORACLE).fetchall()) == want


def test_repair_gives_a_legal_conversation(spark):
    df = spark.createDataFrame(conversations(60), "conv_id long, turn long, role string, text string")
    rows = defaultdict(list)
    for r in dialogue_repair.repair(df).collect():
        rows[r["conv_id"]].append(r)
    for v in rows.values():
        v.sort(key=lambda r: r["place"])
        assert [r["place"] for r in v] == list(range(len(v)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in v if r["edit"] != "D"))
        assert all(r["edit"] == "D" for r in v if r["fault"] in ("blank", "duplicate"))
    assert sum(r["edit"] != "I" for v in rows.values() for r in v) == df.count()
    assert dialogue_repair.audits(df.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    df = spark.range(40_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, CASE WHEN id % 7 = 0 THEN '' ELSE '.' END) AS text")
    r = dialogue_repair.audits(df).collect()[0]
    assert len(r["audit"]) - r["audit"].count("I") == 40_000 and r["truncated"] == len(range(0, 40_000, 7))
    left = 40_000 - r["audit"].count("D") + r["audit"].count("I")
    assert left % 2 == 0 and r["cost"] <= 2 * 40_000


def test_layers_hold_every_state_within_twelve():
    rnd = random.Random(3)
    word, base = dialogue_repair.END, 0
    for _ in range(3000):
        word, base = dialogue_repair.step_back(word, base, rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.3)
        assert word >> 48 & 15 == 15 and word & 15


# bins


def packed(lengths, capacity, got):
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= capacity for b in got)
    return len(got)


def test_search_saves_bins_of_best_fit():
    rnd, saved = random.Random(7), 0
    for capacity, low, high, n in ((100, 20, 50, 400), (100, 25, 45, 400), (1000, 260, 520, 300), (150, 20, 100, 500)):
        lengths = [rnd.randint(low, high) for _ in range(n)]
        first = bins.best_fit(lengths, capacity)
        saved += packed(lengths, capacity, first) - packed(lengths, capacity, bins.assign(lengths, capacity))
    assert saved >= 15


@pytest.mark.parametrize(("lengths", "before", "after"), [([7, 7, 6, 6, 5, 5], [[0], [1], [2, 4], [3, 5]], 3), ([8, 5, 6, 7, 5, 3, 2], [[0], [1], [2], [3], [4], [5], [6]], 4), ([6, 6, 4, 4, 5, 5], [[0, 2], [1], [3, 4], [5]], 3)])
def test_small_searches(lengths, before, after):
    search = bins.Search(lengths, 12, before)
    assert packed(lengths, 12, search.run()) == after


def test_each_step_makes_squared_fill_greater():
    rnd = random.Random(8)
    lengths = [rnd.randint(15, 60) for _ in range(200)]
    search = bins.Search(lengths, 100, [[i] for i in range(200)])
    put, sums = search._step, []

    def step(b):
        before = int((search.fill**2).sum())
        went = put(b)
        sums.append((went, int((search.fill**2).sum()) - before))
        return went

    search._step = step
    packed(lengths, 100, search.run())
    assert sum(w for w, _ in sums) > 100 and all(more > 0 if w else more == 0 for w, more in sums)


def test_no_set_is_packed_better_than_best(spark):
    """Small sets against every way to pack them."""
    rnd, more = random.Random(5), 0

    def best(left, bins_):
        if not left:
            return len(bins_)
        out = len(left) + len(bins_)
        for k in range(len(bins_) + 1):
            room = 20 if k == len(bins_) else bins_[k]
            if left[0] <= room and (k == 0 or k == len(bins_) or bins_[k] != bins_[k - 1]):
                out = min(out, best(left[1:], (*bins_[:k], room - left[0], *bins_[k + 1 :])))
        return out

    for _ in range(60):
        lengths = [rnd.randint(4, 12) for _ in range(7)]
        more += packed(lengths, 20, bins.assign(lengths, 20)) - best(tuple(lengths), ())
    assert 0 <= more <= 2


def gapless(rows):
    """The number of sequences, each of which has its items end to end."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


@pytest.mark.parametrize("longest", [3, 1500, 4096])
def test_open_bins_go_on_to_the_next_round(spark, longest):
    rnd = random.Random(longest)
    items = [(i, rnd.randint(1, longest)) for i in range(6000)]
    df = spark.createDataFrame(items, "serial long, length long").repartition(5)
    got = bins.place(df, group=300, open_bins=1).collect()
    assert sorted((r["serial"], r["length"]) for r in got) == items
    assert gapless(got) <= 1.03 * len(bins.best_fit([n for _, n in items], 4096)) + 2  # groups of 300 only


def test_pieces_and_places(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["stone", "river", "É", "1", "walking."]) for _ in range(rnd.choice([3, 60, 700]))) for _ in range(300)]
    rows = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(900, None, 1, ""), (901, "", 1, ""), (None, "a b c", 1, ""), (902, "word " * 30_000, 2, None), (5, texts[5], 0, "")] + [(903, "same text", 0, "")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, serial int, sequence_id string").repartition(3)
    lib = Tokenizer.from_file(WORD)
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((d, k, 4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096))))
    got = bins.pack(df, WORD).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    short = [r["length"] for r in got if r["length"] < 4096]
    assert gapless(got) <= len(bins.best_fit(short, 4096)) + len(got) - len(short)
    assert bins.pack(df.limit(0), WORD).count() == 0


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_dialogue_repair"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLE_SQL[name])
    assert Counter(tuple(r) for r in df.select(*rel.columns).collect()) == Counter(rel.fetchall())
