from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shelfspark.llm import jaccard
from shelfspark.llm.textops import shingles, word_hashes


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = {tuple(w[k : k + min(width, len(w))]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in holders[s]:
                shared[j] += 1
            holders[s].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(seed, n=500):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(100)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(100)] = f"q{rng.randrange(40 if rng.random() < 0.5 else 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(5000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(200)]
    # A common passage in documents that are otherwise apart.
    rows += [(7000 + i, " ".join(base[:30] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))])) for i in range(150)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_large_group_of_near_copies(documents, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rows = near_copies(width)
    assert result(jaccard.near_classes(documents(rows), width, percent)) == brute(rows, width, percent)


def test_blocks_of_many_sizes_and_salted_tokens(documents, monkeypatch):
    """Near copies cut to many lengths share tokens; small blocks of a few shingles, and one entry a salt."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(jaccard, "SALTED", 8)
    monkeypatch.setattr(jaccard, "FEW", 2)
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(160)]
    rows = []
    for i in range(400):
        w = base[: rng.randint(20, 160)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert result(jaccard.near_classes(documents(rows), 4, 85)) == brute(rows, 4, 85)


def test_sample(documents, sample):
    rows = [r[:2] for r in sample]
    assert result(jaccard.near_classes(documents(rows), 4, 85)) == brute(rows, 4, 85)


def test_edges(documents):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo\n"), (8, long), (9, long + " tail"), (10, "é É"), (11, "é é")]
    assert result(jaccard.near_classes(documents(rows), 4, 85)) == brute(rows, 4, 85)


def test_repeated_and_missing_identifiers(documents):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_classes(documents(rows), 4, 85).collect()), key=repr)
    assert got == sorted([(1, 2, None), (1, 2, None), (None, 2, None), (2, 1, 2)], key=repr)


def test_empty(documents):
    assert jaccard.near_classes(documents([]), 4, 85).count() == 0


def test_filter_keeps_one_of_each_class_and_all_columns(clashing):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (4, None)]
    got = jaccard.near_filter(clashing(rows))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4] and "signature" in got.columns


@given(st.lists(st.sampled_from(["a", "b", "ab", "é", "A"]), max_size=30), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_shingles_count_distinct_windows(words, width):
    text = " ".join(words).encode().lower()
    w = text.split()
    want = {tuple(w[i : i + min(width, len(w))]) for i in range(max(1, len(w) - width + 1))} if w else set()
    assert len(shingles(text, width)) == len(want)


def test_word_hashes_tell_words_apart():
    assert len(np.unique(word_hashes(b"a ab b ba aa a\x00 \xc3\xa9"))) == 7
    assert (word_hashes(b"x  yy\tx") == word_hashes(b"\nx yy x ")).all()


def test_matches_asked_for():
    assert jaccard.pick_matches(np.array([2]), 1) == 1
    assert 1 <= jaccard.pick_matches(np.array([2, 2, 500, 500, 500]), 2) <= jaccard.MOST_MATCHES
