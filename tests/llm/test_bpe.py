from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shelfspark.llm import bpe
from shelfspark.llm.queries import WORD_BPE
from tokenizers import Tokenizer

TEXTS = [
    "",
    "\n \n",
    "It's we'LL they'd",
    "<|endoftext|>a <|startoftext|>B<|endoftext|>",
    "ΣΑΣ Σ İstanbul ﬁ ǅ ẞ",
    "á b \x1c c\x85d e",
    "12 ٣ 漢字 😀😀",
    "x" * 5000,
    "ab" * 3000 + "é" * 500,
    "thethethe" * 900 + " end",
    "word " * 30_000,
    "e​́ ́x",
]


def expected(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    plain = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def test_as_the_library(spark, documents, sample, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + r[0], r[1]) for r in sample] + [(99, None)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(documents(rows), WORD_BPE).collect()}
    assert got == {i: expected(library, t or "") for i, t in rows}


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert bpe.encode_text(bpe.load(WORD_BPE), text) == expected(LIBRARY, text)


LIBRARY = Tokenizer.from_file(WORD_BPE)


def test_streams_equal_whole_runs():
    rng = random.Random(1)
    for _ in range(200):
        tokens, merges = list("abc"), []
        for _ in range(rng.randint(1, 14)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if pair not in merges and len("".join(pair)) < 9 and "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        merger = bpe.Merger(merges, block=3)
        run = [rng.choice("abc") for _ in range(rng.randint(1, 300))]
        assert list(merger.stream(iter(run))) == merger._merge_long(run), merges


def test_both_merges_agree():
    merger = bpe.load(WORD_BPE).merger
    rng = random.Random(2)
    for _ in range(300):
        run = [rng.choice("aeinrst") for _ in range(rng.randint(1, bpe.PIECE))]
        assert merger.merge(list(run)) == merger._merge_long(run)


def test_lookahead_grows_along_chains():
    assert bpe.lookahead([("a", "b")]) == 2
    assert bpe.lookahead([("a", "b"), ("c", "a"), ("d", "c")]) > bpe.lookahead([("a", "b"), ("c", "d")])


def test_chunks_lose_nothing():
    text = "abc déf\n" * 2000 + "x" * 50_000
    parts = [text[a:b] for a, b in bpe.spans(text, 100)]
    assert "".join(parts) == text and len(parts) > 100
    assert [a for a, _ in bpe.spans(text, 100, 7, 300)][0] == 7 and list(bpe.spans("")) == []


LONG = [
    "ab" * 400_000,
    "é" * 70_000 + "e\u0301" * 100_000 + "1" * 70_000,
    "!?" * 120_000 + "'s" + "..." * 50_000 + "it's" * 40_000,
    "漢字" * 100_000 + "\u3000" + "한국" * 60_000 + "\u1112\u1161\u11ab" * 30_000 + "\u00a0Σ" * 70_000,
    "x" * 200_000 + "<|endoftext|>" + "Y" * 140_000 + " z",
    "a" + "\u0301\u0323" * 80_000 + "b" * 70_000,
]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_long_stretches_without_a_blank(text, library):
    assert bpe.encode_text(bpe.load(WORD_BPE), text) == expected(library, text)


def test_memory_does_not_follow_the_length():
    """What encoding a word without a blank takes beside the text: the same for two million code points as for some hundred thousand."""
    import tracemalloc

    model, peaks = bpe.load(WORD_BPE), []
    bpe.encode_text(model, "warm up " * 100)
    for n in (300_000, 2_000_000):
        text = "abcdefghij" * (n // 10)
        tracemalloc.start()
        bpe.encode_text(model, text)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + (1 << 20), peaks


def test_lengths_of_tokens():
    merger = bpe.load(WORD_BPE).merger
    symbols = [*"there", "d</w>"]
    assert sum(bpe._length(t) for t in merger.merge(list(symbols))) == len(symbols)


def test_ids_and_empty_table(documents):
    rows = {r.doc_id: bytes(r.ids) for r in bpe.bpe_encode(documents([(1, "the cat"), (2, None)]), WORD_BPE).collect()}
    assert len(rows[1]) == 8 and rows[2] == b""
    assert bpe.bpe_digests(documents([]), WORD_BPE).count() == 0


def test_clashing_columns(clashing):
    assert bpe.bpe_digests(clashing([(1, "a")]), WORD_BPE).count() == 1
