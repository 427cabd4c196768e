"""Exact token counts of every prefix by dynamic programming.

Inside a word, the last token of each prefix's encoding is found from those of shorter prefixes: token t may end
the prefix of length i if the prefix of length i - len(t) ends in a token that stands unmerged before t. There is
always exactly one such t, and the count is one more than at i - len(t). The tokens that may end there come from an
automaton over the vocabulary, so a word costs time in proportion to its length. Whole words add up, and a cut inside
a text changes nothing before the word that it falls into but for white space, which becomes one run at the end. So the
counts of all prefixes answer how many tokens any of them has, and where a budget ends, without encoding again.

Null and empty texts have no tokens. Repeated rows are counted each; columns besides the id and the text are not read;
a table without rows gives none.
"""

from __future__ import annotations

from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens

PAIRS = 150_000  # entries of the memo of neighbouring tokens
#: White space of the pre-tokeniser beyond the plain one.
WIDE = "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = tokens.SPACES + WIDE

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"


class Prefixes:
    """Counts for the prefixes of words of a byte-level tokenizer."""

    def __init__(self, tok: tokens.Tokenizer):
        if not tok.by_bytes:
            raise ValueError("prefix counts need the byte-level pre-tokeniser")
        self.tok, self.stand = tok, {}
        self.ending = ahocorasick.Automaton()
        for t in tok.vocab:
            self.ending.add_word(t, t)
        self.ending.make_automaton()

    def stands(self, a: str, b: str) -> bool:
        """Whether token b after token a stays as it is (a empty: b alone)."""
        key = (a, b)
        if (known := self.stand.get(key)) is None:
            if len(self.stand) > PAIRS:
                self.stand.clear()
            known = self.stand[key] = [t.value for t in self.tok.lib.model.tokenize(a + b)] == ([a, b] if a else [b])
        return known

    def counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, by its bytes, from the empty one on."""
        if word in self.tok.special:
            return [0] + [1] * len(word.encode())
        letters, known = tokens.lettered(word), self.stand.get
        count, last = [0] * (len(letters) + 1), [""] * (len(letters) + 1)
        for end, t in self.ending.iter(letters):
            i = end + 1
            if last[i]:
                continue
            j = i - len(t)
            if (ok := known((last[j], t))) or ok is None and self.stands(last[j], t):
                count[i], last[i] = count[j] + 1, t
        return count

    def _by_chars(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, by its characters, from the empty one on."""
        by_bytes = self.counts(word)
        return by_bytes if word.isascii() else [by_bytes[b] for b in accumulate((len(c.encode()) for c in word), initial=0)]

    def count(self, text: str) -> int:
        return sum(self.counts(w)[-1] for w in self.tok.words(text))

    def cuts(self, words: list[str], ends: list[int], k: int) -> list[int]:
        """Tokens of the text up to the first, second, ... last character of word k, as a text that ends there.

        `ends`: tokens before each word. A special string that is cut is plain text, and joins the words before it.
        """
        w = words[k]
        if w in self.tok.special:
            lo = max(0, k - 3)
            lead = "".join(words[lo:k])
            return [ends[lo] + self.count(lead + w[:c]) for c in range(1, len(w))] + [ends[k] + 1]
        if w in tokens.SAID:
            return [ends[k] + self.count(w[:c]) for c in range(1, len(w) + 1)]
        lead = len(w) - len(w.lstrip(SPACES))
        before = words[k - 1] if k and lead and not words[k - 1].strip(SPACES) else ""
        run = self._by_chars(before + w[:lead])[len(before) + 1 :]
        base = ends[k - 1] if before else ends[k]
        return [base + n for n in run] + [ends[k] + n for n in self._by_chars(w)[lead + 1 :]]

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of each prefix of a text, by its characters, from the empty one on."""
        words = self.tok.words(text)
        ends = list(accumulate((self.counts(w)[-1] for w in words), initial=0))
        return [0] + [n for k in range(len(words)) for n in self.cuts(words, ends, k)]

    def truncate(self, words: list[str], ends: list[int], budget: int) -> int:
        """How many characters the longest prefix of a text has that keeps to a budget, from its words and the tokens
        before each of them, and in all.

        It ends in the first word to pass the budget, or in one after it that white space or a special string joins.
        """
        if ends[-1] <= budget:
            return sum(map(len, words))
        k = next(i for i, n in enumerate(ends) if n > budget) - 1
        at = list(accumulate(map(len, words[: k + 4]), initial=0))
        for j in reversed(range(len(at) - 1)):
            if j <= k or words[j] in self.tok.special or words[j][0] in SPACES:
                for c, n in reversed([*enumerate(self.cuts(words, ends, j), 1)]):
                    if n <= budget:
                        return at[j] + c
        return 0


def prefix_memo(path: str) -> tokens.Memo:
    """Words to the tokens of the whole word."""
    table = Prefixes(tokens.load(path))
    out = tokens.Memo(table.tok, lambda words: [table.counts(w)[-1] for w in words])
    out.table = table
    return out


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its bytes, its tokens, whether they pass the limit, and the characters that fit the limit."""

    def run(batches):
        memo = tokens.memo("prefixes", tokenizer, prefix_memo)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in tokens.slices(texts):
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                values, words = memo.values_of(part)
                of = words.of.to_numpy()
                upto = np.concatenate([[0], np.cumsum(np.array(values, dtype=np.int64)[of])])
                first, rows = 0, []
                for text, last in zip(part, words.ends.tolist()):
                    n, fits = int(upto[last] - upto[first]), len(text)
                    if n > limit:
                        # words beyond the budget are needed only as far as truncate looks
                        stop = min(last, int(np.searchsorted(upto, upto[first] + limit, side="right")) + 4)
                        head = [words.distinct[i] for i in of[first:stop].tolist()]
                        fits = memo.table.truncate(head, (upto[first : stop + 1] - upto[first]).tolist(), limit)
                    rows.append((len(text.encode()), n, n > limit, fits))
                    first = last
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c, pa.bool_() if k == 2 else pa.int64()) for k, c in enumerate(cols))], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCHEMA)
