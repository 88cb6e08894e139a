from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfspark.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * max(-(2**17), min(2**17, float(np.float32(x))))) for x in v], label))
    kept = [r for r in kept if r[1] and len(r[1]) % 4 == 0]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // 4
    order = [r for r in order if len(r[1]) == 4 * width]
    parts = lambda r, k: tuple(r[1][k * width : (k + 1) * width])
    books = [[parts(r, k) for r in order[:256]] for k in range(4)]

    def assign(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(4):
        for k in range(4):
            groups = defaultdict(list)
            for part, n in Counter(parts(r, k) for r in order).items():
                groups[assign(part, books[k])[1]].append((part, n))
            for i, found in groups.items():
                total = sum(n for _, n in found)
                books[k][i] = tuple(sum(p[j] * n for p, n in found) // total for j in range(width))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded, by_label = [], Counter()
    for r in order:
        found = [assign(parts(r, k), books[k]) for k in range(4)]
        coded.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(e for e, _ in found), r[2]))
        by_label[r[2]] += coded[-1][2]
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in coded), key=repr)


def result(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def random_rows(n, dims=8, seed=0):
    rng = random.Random(seed)
    return [(i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(dims)], rng.choice([1, 2, None])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


EDGES = [
    (None, [1.0, 2.0, 3.0, 4.0], 1), (5, None, 1), (6, [1.0, None, 2.0, 3.0], 1), (7, [float("nan"), 1.0, 1.0, 1.0], 2), (8, [float("inf"), 1.0, 1.0, 1.0], 2),
    (1, [-0.0005, 0.1, -1.0, 3e30], None), (1, [-0.0005, 0.1, -1.0, 3e30], None), (1, [0.0, 0.0, 0.0, 0.0], 1), (2, [1.0, 2.0], 3), (3, [], 3), (4, [1.0] * 8, 3), (9, [-3e30, 1.0, 1.0, 1.0], 2),
]


def test_edges(spark):
    found = result(V.vector_codes(frame(spark, EDGES)))
    assert found == brute(EDGES) and len(found) == 5


@pytest.mark.parametrize("n", [3, 256, 400])
def test_against_brute_force(spark, n):
    rows = random_rows(n, seed=n)
    assert result(V.vector_codes(frame(spark, rows))) == brute(rows)


def test_hot_vector_and_label(spark):
    rows = random_rows(330) + [(1000 + i, [0.25] * 8, 7) for i in range(300)]
    assert result(V.vector_codes(frame(spark, rows))) == brute(rows)


def test_heavy_and_light_keys_join_alike(spark, monkeypatch):
    rows = random_rows(300)
    want = result(V.vector_codes(frame(spark, rows)))
    for heavy in (1, 1 << 40):
        monkeypatch.setattr(V, "HEAVY", heavy)
        assert result(V.vector_codes(frame(spark, rows))) == want


def test_nearest_is_exact_and_takes_the_lower_index():
    rng = np.random.default_rng(1)
    for top in (50, 1 << 20, 1 << 27):
        parts, book = rng.integers(-top, top, (200, 16)), rng.integers(-top, top, (64, 16))
        book[40] = book[7]
        parts[:20] = book[7]
        index, error = V.nearest(parts, book)
        for x, i, e in zip(parts.tolist(), index.tolist(), error.tolist()):
            every = [sum((a - b) ** 2 for a, b in zip(x, y)) for y in book.tolist()]
            assert e == min(every) and i == every.index(e)


def test_empty(spark):
    out = V.vector_codes(frame(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert V.vector_codes(frame(spark, [(1, None, 1)])).count() == 0


def test_clashing_columns(spark):
    rows = random_rows(20)
    extra = frame(spark, rows).withColumns({c: F.lit("x") for c in ("row", "parts", "part", "position", "n", "code", "error", "v", "r_label", "label_error", "entry")})
    assert result(V.vector_codes(extra)) == brute(rows)
