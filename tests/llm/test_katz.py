from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shelfspark.llm import katz
from shelfspark.llm.textops import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = None


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [END]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


class Model:
    """The same model over dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            last = END
            for w in words_of(text):
                self.words[w] += 1
                self.pairs[last, w] += 1
                last = w
        self.total = sum(self.words.values())
        self.d1, self.d2 = self.discounts(self.words), self.discounts(self.pairs)
        self.before = defaultdict(dict)
        for (v, w), n in self.pairs.items():
            self.before[v][w] = n
        self.unknown = 1 - sum(self.share(n, self.d1) * n for n in self.words.values()) / self.total if self.total else 1.0
        self.alpha = {}
        for v, found in self.before.items():
            c = sum(found.values())
            self.alpha[v] = (1 - sum(self.share(n, self.d2) * n for n in found.values()) / c) / (1 - sum(self.word(w) for w in found))

    @staticmethod
    def discounts(table):
        counts = Counter(table.values())
        out = {}
        for r in range(1, 6):
            x = (r + 1) * counts[r + 1] / (r * counts[r]) if counts[r] else 0
            out[r] = x if 0 < x < 1 else (r + 1) / (r + 2)
        return out

    @staticmethod
    def share(n, d):
        return d.get(n, (n + 1) / (n + 2))

    def word(self, w):
        n = self.words.get(w, 0)
        return self.share(n, self.d1) * n / self.total if n else self.unknown

    def p(self, v, w):
        found = self.before.get(v)
        if not found:
            return self.word(w)
        if w in found:
            return self.share(found[w], self.d2) * found[w] / sum(found.values())
        return self.alpha[v] * self.word(w)

    def score(self, text):
        tokens = words_of(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip([END, *tokens], tokens))

    def base(self, text):
        return sum(math.log10((self.words.get(w, 0) + 0.1) / (self.total + 0.1 * (len(self.words) + 1))) for w in words_of(text))


def brute(rows):
    model = Model([t for i, t in rows if not held(i)])
    out = []
    for i, t in rows:
        tokens = words_of(t)
        out.append((i, held(i), len(tokens), sum(w in model.words for w in tokens), model.total, model.base(t), model.score(t)))
    return model, sorted(out, key=lambda r: (repr(r[0]), repr(r[5])))


def result(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=lambda r: (repr(r[0]), repr(r[5])))


def same(found, want):
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


ROWS = [(i, f"The cat {i % 7} sat on the {'mat' if i % 3 else 'hat'} of {i}") for i in range(60)] + [
    (100, None), (101, ""), (102, " \n\t "), (None, "the cat"), (None, None), (103, "the the the the"), (103, "the the the the"), (103, "other"), (104, "ÉÜ the İ"), (105, "x " * 30_000 + " y"), (106, "a" * 100_000),
]


def test_against_dictionaries(documents):
    _, want = brute(ROWS)
    assert any(r[1] for r in want) and not all(r[1] for r in want)
    same(result(katz.lm_scores(documents(ROWS))), want)


def test_sample_and_held_out_gain(documents, sample):
    rows = [r[:2] for r in sample]
    _, want = brute(rows)
    found = result(katz.lm_scores(documents(rows)))
    same(found, want)
    out = [r for r in found if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)


def test_probabilities_sum_to_one():
    model = Model([t for _, t in ROWS])
    for v in [*model.words, "never seen"]:
        assert sum(model.p(v, w) for w in [*model.words, "never seen"]) == pytest.approx(1, abs=1e-12)


def test_backoff_weights_are_exactly_normalised(spark, documents):
    """From the tables that Spark makes: seen pairs, and alpha times the rest."""
    rows = katz.keyed(documents(ROWS))
    words = katz.word_counts(rows).toPandas()
    pairs = katz.pair_counts(rows, words.word.tolist())
    total = int(words.n.sum())
    model = Model([t for i, t in ROWS if not held(i)])
    d1, d2 = list(model.d1.values()), list(model.d2.values())
    table = pairs.join(spark.createDataFrame(words.rename(columns={"n": "word_n"})), "word")
    found = katz.contexts(table.select("before", "word", "n", "word_n"), d1, d2, total).toPandas().set_index("before")
    assert len(found) == len(model.alpha)
    for w, want in model.alpha.items():
        h = katz.END if w is END else word_hashes(w.encode())[0]
        row = found.loc[np.array([h], np.uint64).view(np.int64)[0]]
        assert row.alpha == pytest.approx(want, rel=1e-9) and row.n == sum(model.before[w].values())


@pytest.mark.parametrize("hot, pair, size, coarse", [(2, 2, 1 << 20, 3), (1 << 30, 8, 500, 3), (1 << 30, 1 << 30, 200, 3), (64, 64, 100, 4096), (1 << 30, 8, 40, 2)])
def test_hot_words_and_pairs_and_finer_buckets(documents, monkeypatch, hot, pair, size, coarse):
    """Every word frequent, or many pairs salted, or many buckets, coarse and fine."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "HOT_PAIR", pair)
    monkeypatch.setattr(katz, "BUCKET_BYTES", size)
    monkeypatch.setattr(katz, "COARSE", coarse)
    rows = [r for r in ROWS if len(r[1] or "") < 1000]
    same(result(katz.lm_scores(documents(rows, 7))), brute(rows)[1])


def test_no_training_documents(documents):
    rows = [(i, "some words") for i in range(200) if held(i)]
    found = result(katz.lm_scores(documents(rows)))
    assert len(found) == len(rows) and all(r[2:] == (3, 0, 0, 0.0, 0.0) for r in found)


def test_empty(documents):
    assert katz.lm_scores(documents([])).count() == 0


def test_clashing_columns(documents):
    docs = documents(ROWS[:40]).withColumns({c: F.lit("x") for c in ("key", "held", "n", "kind", "word", "before", "base", "rest", "seen", "times", "backed", "held_out", "score")})
    same(result(katz.lm_scores(docs)), brute(ROWS[:40])[1])


def test_tokens_of_texts():
    texts = ["A b", "", None, " \x0b", "c"]
    tokens, each = katz.tokens_of(pa.array(texts))
    assert each.tolist() == [3, 1, 1, 1, 2]
    h = lambda w: int(word_hashes(w)[0])
    assert tokens.tolist() == [h(b"a"), h(b"b"), 1, 1, 1, 1, h(b"c"), 1]
    assert katz.before(tokens).tolist() == [1, *tokens.tolist()[:-1]]
