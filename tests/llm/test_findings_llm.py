"""Cases of findings: pairs that bitmaps rule out, work by slices, and their size."""

import numpy as np
import pyarrow as pa

from quaestor.llm import jaccard_join as J
from quaestor.llm import packing
from quaestor.llm import para_dedup as P
from quaestor.llm import shingles as S


def test_groups_that_are_not_similar_enough_make_no_pairs():
    rnd = np.random.default_rng(4)
    draw = lambda n: rnd.integers(0, 1 << 63, n, dtype=np.uint64)
    common = draw(240)  # 240 of 360 are two thirds
    far = [np.unique(np.concatenate([common, draw(60)])) for _ in range(60)]
    near = [np.unique(np.concatenate([far[0][:290], draw(10)])) for _ in range(3)]
    rows = [(J._at(0, 300, 0), k, k, 0, S.bitmap(x)) for k, x in enumerate(far + near)]
    got = {(a, b) for a, b, _ in J._near(rows, 80, False)}
    similar = {(a, b) for b in range(63) for a in range(b) if 100 * J.similarity(*((far + near)[i] for i in (a, b)))[0] >= 80 * J.similarity(*((far + near)[i] for i in (a, b)))[1]}
    assert similar <= got and len(similar) == 6 and len(got) < 60  # of 1,953
    assert all(len(S.bitmap(x)) * 8 <= 1 << 16 for x in (draw(70_000), draw(3)))


def test_keys_of_a_slice_are_made_at_once(monkeypatch):
    rnd = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rnd.integers(0, 400, n)) + "\n" * (n % 3) + "e\u0301 v " * (n % 70) for n in rnd.integers(0, 300, 40)] + ["", " ", "x " * 400, "a b\n" * 90]
    rows = lambda got, d: sorted(zip(*(x.tolist() for x in (got[0].view(np.int64), got[1], got[2] + d, got[3], got[4]))))
    alone = sorted(r for d, t in enumerate(texts) for r in rows(P._rows_of([t]), d))
    calls, rolled = [], S.rolled
    monkeypatch.setattr(S, "rolled", lambda *x: calls.append(1) or rolled(*x))
    assert rows(P._rows_of(texts), 0) == alone
    assert len(calls) <= 2


def test_packing_encodes_bounded_slices(monkeypatch):
    sizes = []
    monkeypatch.setattr(packing.tokens, "encode_texts", lambda _, texts: sizes.append(sum(map(len, texts))) or [b"\2\0\0\0"] * len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * 200_000] * 40)], names=["doc_id", "text"])
    out = list(packing._packed([batch], packing.Packer(0, 2048, 4000), "", b"\1\0\0\0"))
    assert sum(sizes) == 8_000_000 and max(sizes) <= 1_000_000
    assert sum(b.num_rows for b in out) >= 40
