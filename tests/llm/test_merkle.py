from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from shelfspark.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row, text):
    return sha("".join(field(x) for x in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def path(levels, at):
    """Siblings to the left and right, level by level."""
    out = []
    for level in levels[:-1]:
        run, own = at // 8 * 8, at % 8
        out.append(("".join(level[run : run + own]), "".join(level[run + own + 1 : run + 8])))
        at //= 8
    return out


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups["" if row[2] is None else "=" + row[2]].append(row)
    keys = sorted(groups, key=lambda k: k.encode())
    trees = {}
    for key in keys:
        groups[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[key] = tree([leaf_of(r, r[1]) for r in groups[key]])
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for at, key in enumerate(keys):
        for i, row in enumerate(groups[key]):
            siblings = path(trees[key], i) + path(top, at)
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            cur = leaf_of(row, text)
            for left, right in siblings:
                cur = sha(left + cur + right)
            out.append((row[0], leaf_of(row, row[1]), trees[key][-1][0], top[-1][0], sha("".join(a + b for a, b in siblings)), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=repr)


def full(rows):
    """Rows as the documents fixture makes them."""
    return [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]


ROWS = [
    (1, "A"), (2, None), (3, ""), (3, ""), (3, "Other"), (None, "No Number"), (None, None, None, None), (9, "É ß 日本", "fr"), (10, "X" * 100_000, "fr", None),
    (-5, "Minus", "de"), (6, "alone", "zz"), (7, "a", "é"), (8, "B", ""), (12, "C C", None),
]


def test_against_brute_force(documents):
    assert result(merkle.merkle_manifest(documents(ROWS))) == brute(full(ROWS))


def test_sample(documents, sample, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    found = result(merkle.merkle_manifest(docs))
    assert found == brute(rows)
    assert not all(r[-1] for r in found) and sum(r[-1] for r in found) > len(rows) / 2


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 200])
def test_several_climbs(documents, monkeypatch, n):
    """With buckets of 64 leaves the roots of buckets are climbed from again, and so are those of languages."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SPAN", 8)
    monkeypatch.setattr(merkle, "ROWS", 16)
    rng = random.Random(n)
    rows = [(rng.randrange(10 * n), f"Text {i}", "en" if i % 3 else f"l{i % 11}") for i in range(n)]
    assert result(merkle.merkle_manifest(documents(rows))) == brute(full(rows))


def test_many_languages(documents):
    rows = [(i, f"T {i}", f"lang-{i % 150}") for i in range(400)]
    assert result(merkle.merkle_manifest(documents(rows))) == brute(full(rows))


def test_a_bucket_that_spans_batches(documents, spark):
    rows = [(i, f"T {i}", "en" if i % 4 else "de") for i in range(6000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    found = result(merkle.merkle_manifest(documents(rows)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == brute(full(rows))


def test_empty(documents):
    out = merkle.merkle_manifest(documents([]))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_clashing_columns(documents):
    from pyspark.sql import functions as F

    docs = documents(ROWS).withColumns({c: F.lit("x") for c in ("key", "leaf", "pos", "n", "h", "bucket", "p", "depth", "b", "row", "seq", "part", "root", "subroot")})
    assert result(merkle.merkle_manifest(docs)) == brute(full(ROWS))
