"""Words, prefix counts, packing and wavelet files against the library and plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quaestor.llm import packing, token_counts, tokens, wavelet  # noqa: E402

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["'s", "'ll", "'", "'re", " ", "  ", "\n", "\t", "a", "B", "é", "İ", "ß", "1", "23", "!", '"', "日本", " ", "\x1c", "\x85", "\xa0", "don't", "''s", "'r", "<|endoftext|>", "<|startoftext|>", "<|", "Ʀ", "ing", "the "]


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def counted(lib, text):
    return len(lib.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_odd_texts_are_encoded_as_the_library_does(path, monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 50)
    lib, texts = Tokenizer.from_file(path), odd_texts(900)
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for _ in range(2):
        assert [x for s in range(0, 900, 250) for x in tokens.encode_texts(path, texts[s : s + 250])] == want


def test_unknown_tokenizers_are_refused(tmp_path):
    file = tmp_path / "t.json"
    file.write_text(open(BYTE, encoding="utf-8").read().replace('"dropout": null', '"dropout": 0.5').replace('"dropout":null', '"dropout":0.5'))
    with pytest.raises(ValueError, match="plain BPE"):
        tokens.Tokenizer(str(file))


def test_counts_of_every_prefix_of_texts_and_where_budgets_end():
    table, lib = token_counts.Prefixes(tokens.load(BYTE)), Tokenizer.from_file(BYTE)
    for t in odd_texts(150, 5):
        want = [counted(lib, t[:c]) for c in range(len(t) + 1)]
        assert table.prefix_counts(t) == want
        words = table.tok.words(t)
        ends = np.cumsum([0, *(table.counts(w)[-1] for w in words)]).tolist()
        for budget in (0, 1, 3, 7, 12):
            assert table.truncate(words, ends, budget) == max(c for c, n in enumerate(want) if n <= budget)


def test_a_run_of_a_million_characters_is_cut_at_its_budget(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh") for _ in range(1_000_000))
    row = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE).first()
    lib = Tokenizer.from_file(BYTE)
    assert counted(lib, text[: row["limit_chars"]]) <= 1024 and row["over_limit"] and row["n_tokens"] == counted(lib, text)
    assert all(counted(lib, text[: row["limit_chars"] + k]) > 1024 for k in range(1, 20))


def test_most_of_what_remains_is_packed_by_bin_slack():
    rnd = random.Random(7)
    packer, rest = packing.Packer(0, 256, 400), 0
    for d in range(3000):
        n = min(2000, int(rnd.paretovariate(0.9) * 20))
        rest += n % 256
        packer.add(d, bytes(4 * n))
    packer.settle(last=True)
    pieces, kinds, windows = packer.pieces(), Counter(), defaultdict(int)
    for p in pieces:
        kinds[p[7]] += p[2]
        windows[p[5]] += p[2]
    assert kinds["fit"] >= 0.9 * rest and kinds["tail"] < 256 and not packer.n_waiting
    assert all(n == 256 or n & (n - 1) == 0 for n in windows.values())


def test_equal_lengths_that_never_fill_a_window_are_packed():
    packer = packing.Packer(0, 100, 10)
    for d in range(95):
        packer.add(d, bytes(4 * 30))
    packer.settle(last=True)
    per, place = defaultdict(list), defaultdict(list)
    for d, start, n, _, total, s, offset, _ in packer.pieces():
        per[d].append((start, n))
        place[s].append((offset, n))
    for d in range(95):
        at = 0
        for start, n in sorted(per[d]):
            assert start == at
            at += n
        assert at == 30
    for v in place.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at == 100 or at & (at - 1) == 0


def test_wavelet_directory_and_many_occurrences():
    ids = np.random.default_rng(4).integers(0, 7, size=2 * wavelet.BLOCK + 777).astype("<u4")
    ids[::1000] = 300
    shard = wavelet.Shard(wavelet.build([1], [len(ids)], ids))
    for i in (0, 1, 63, 64, 511, 512, 513, wavelet.BLOCK - 1, wavelet.BLOCK, wavelet.BLOCK + 1, len(ids)):
        assert shard.rank(3, i) == int((ids[:i] == 3).sum()) and (i == len(ids) or shard.access(i) == ids[i])
    assert shard.occurrences(5) == np.flatnonzero(ids == 5).tolist() and shard.select(300, 7) == 7000 and shard.occurrences(9) == []
    assert wavelet.Shard(wavelet.build([], [], ids[:0])).tokens().tolist() == []
