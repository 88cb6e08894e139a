from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from shelfspark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(doc_id, seed=0):
    name = f"{seed}|{'' if doc_id is None else doc_id}"
    return int(hashlib.md5(name.encode()).hexdigest()[:10], 16)


def solve(shares, target, factor):
    kind, want = target

    def measure(a):
        z = sum(p**a for p in shares)
        if kind != "max_repeats":
            return -sum(p**a / z * math.log(p**a / z) for p in shares)
        return max(factor * p ** (a - 1) / z for p in shares)

    if kind == "entropy_share":
        want = measure(1) + want * (measure(0) - measure(1))
    if measure(0) <= want:
        return 0.0
    if measure(1) > want:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if measure(middle) <= want else (middle, high)
    return high


def brute(rows, target, factor=1.0, seed=0):
    docs = [(i, s or "", max(1, len(WORD.findall(t or "")))) for i, t, _, s in rows]
    tokens = defaultdict(int)
    for _, s, n in docs:
        tokens[s] += n
    total = sum(tokens.values())
    a = solve([n / total for n in tokens.values()], target, factor)
    z = sum((n / total) ** a for n in tokens.values())
    copies = {}
    for s, own in tokens.items():
        weight = (own / total) ** a / z
        quota = weight * total * factor
        epochs = math.floor(quota / own + mixing.EPOCH_DUST)
        rest = max(0.0, quota - epochs * own)
        by_key = defaultdict(list)
        for i, t, n in docs:
            if t == s:
                by_key[key(i, seed)].append((i, n))
        used, full = 0, False
        for u in sorted(by_key):
            n = sum(x for _, x in by_key[u])
            full = full or used + n > rest
            used += n
            for i, _ in by_key[u]:
                copies[i] = (epochs + (not full), weight)
    return copies


def rows_of(sizes, words=10):
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + k, "w " * (words + k % 7), "en", s) for k in range(n)]
    return rows


@pytest.mark.parametrize("target,factor", [(("max_repeats", 4.0), 1.0), (("max_repeats", 1.5), 1.0), (("entropy", 1.0), 1.0), (("entropy", 0.2), 0.5), (("entropy_share", 0.5), 1.0), (("entropy_share", 0.9), 0.7), (("max_repeats", 3.0), 2.0)])
def test_against_brute_force(documents, target, factor):
    rows = rows_of({"big": 150, "middle": 40, "small": 12, "tiny": 3})
    got = {r.doc_id: (r.copies, r.weight) for r in mixing.mix_counts(documents(rows), target, factor).collect()}
    want = brute(rows, target, factor)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 2e-6 for i in got)


def test_sample(documents, sample):
    got = {r.doc_id: r.copies for r in mixing.mix_counts(documents(sample)).collect()}
    assert got == {i: c for i, (c, _) in brute(sample, ("max_repeats", mixing.MAX_REPEATS)).items()}


def test_limits_hold(documents):
    rows = rows_of({"big": 300, "small": 5})
    got = mixing.mix_counts(documents(rows), ("max_repeats", 2.0)).collect()
    assert max(r.copies for r in got) <= 2
    assert sum(r.copies * r.n_tokens for r in got) <= sum(r.n_tokens for r in got) * (1 + 1e-6)


def test_rows_of_the_mixture(clashing):
    rows = rows_of({"big": 60, "small": 4})
    df = clashing(rows)
    got = mixing.mix(df)
    assert got.columns == df.columns
    times = defaultdict(int)
    for r in got.collect():
        times[r.doc_id] += 1
    assert times == {i: c for i, (c, _) in brute(rows, ("max_repeats", mixing.MAX_REPEATS)).items() if c}


def test_edges(documents):
    assert mixing.mix_counts(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0
    rows = [(1, None, "en", None), (2, "", "en", ""), (3, "a b", "en", "x"), (3, "a b", "en", "x"), (None, "c", "en", "x")]
    got = mixing.mix_counts(documents(rows)).collect()
    assert len(got) == 5 and {r.n_tokens for r in got if r.source == ""} == {1}
    assert len({r.copies for r in got if r.doc_id == 3}) == 1


def test_one_source(documents):
    got = mixing.mix_counts(documents(rows_of({"only": 30}))).collect()
    assert {r.copies for r in got} == {1}


def test_the_registered_target_binds(spark, sf_dir):
    """On the driver's documents the exponent lies inside the interval, and sources get neither their own nor equal weights."""
    from shelfspark.llm.queries import MIX_TARGET

    meta = mixing.token_meta(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = mixing.plan_mix(meta, MIX_TARGET).collect()
    assert 0.05 < plan[0].exponent < 0.95
    entropy = lambda w: -sum(x * math.log(x) for x in w)
    own, got = entropy([r.share for r in plan]), entropy([r.weight for r in plan])
    assert abs(got - (own + math.log(len(plan))) / 2) < 1e-6


def test_tokens_from_a_column_and_long_texts(documents):
    from pyspark.sql import functions as F

    rows = [(i, "w " * 5, "en", "a" if i % 3 else "b") for i in range(30)]
    df = documents(rows).withColumn("tokens", F.when(F.col("doc_id") != 4, F.col("doc_id") * 2))
    got = {r.doc_id: r.n_tokens for r in mixing.mix_counts(df, token_col="tokens").collect()}
    assert got == {i: max(1, 0 if i == 4 else 2 * i) for i in range(30)}
    assert mixing.mix_counts(documents([(1, "w " * 500_000), (2, "w")])).agg({"n_tokens": "max"}).first()[0] == 500_000


@pytest.mark.parametrize("target", [("entropy", 1.0), ("entropy", 0.0), ("entropy", 9.0), ("entropy_share", 0.0), ("entropy_share", 0.5), ("entropy_share", 1.0), ("max_repeats", 1.0), ("max_repeats", 1.7), ("max_repeats", 50.0)])
def test_few_and_many_sources_are_solved_alike(spark, monkeypatch, target):
    shares = spark.createDataFrame([(x / 100,) for x in (50, 20, 15, 10, 4, 1)], "share double")
    few = mixing.solve_exponent(shares, target)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 2)
    assert abs(few - mixing.solve_exponent(shares, target)) <= 2**-39
