from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from shelfspark.llm.exact_dedup import DigestFilter, DigestIndex, exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "A"), (7, "a "), (7, "a "), (9, "x" * 100_000), (10, "x" * 100_000), (None, "a"), (None, "only")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_against_brute_force(documents):
    assert result(exact_dedup(documents(ROWS))) == brute(ROWS)


def test_sample(documents, sample):
    rows = [r[:2] for r in sample]
    assert result(exact_dedup(documents(rows))) == brute(rows)


@pytest.mark.parametrize("digits", [1, 2])
def test_colliding_digests_are_told_apart_by_bytes(documents, digits):
    rows = [(i, f"text {i % 23}") for i in range(80)]
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1) if digits == 2 else F.unhex(F.lit("00"))
    assert result(exact_dedup(documents(rows), digest=weak)) == brute(rows)


def test_empty(documents):
    assert exact_dedup(documents([])).count() == 0


def test_clashing_columns(clashing):
    assert result(exact_dedup(clashing(ROWS[:5]))) == brute(ROWS[:5])


def rows_of(df):
    return {bytes(r.digest): (r.min_id, r.max_id, r.n) for r in df.collect()}


def test_index_merges_runs(spark):
    index = DigestIndex(spark)
    flush = lambda part: {bytes(r.digest) for r in index.flush(spark.createDataFrame(part, "id bigint, digest binary")).collect()}
    assert flush([(1, b"a"), (5, b"b")]) == set()
    # Every hit is found; a filter may pass others.
    assert {b"a", b"b"} <= flush([(3, b"a"), (2, b"b"), (8, b"d")])
    assert b"d" in flush([(4, b"c"), (6, b"d")])
    assert [level for _, level, _ in index.runs] == [1, 0]
    want = {b"a": (1, 3, 2), b"b": (2, 5, 2), b"c": (4, 4, 1), b"d": (6, 8, 2)}
    assert rows_of(index.compact()) == want and len(index.runs) == 1
    assert b"c" in flush([(9, b"c"), (9, b"c")])
    assert rows_of(index.compact())[b"c"] == (4, 9, 3)


def test_files_of_a_run_hold_disjoint_ranges(spark):
    """Read from the files' own statistics."""
    from urllib.parse import urlsplit

    import pyarrow.parquet as pq

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = DigestIndex(spark)
    for k in range(3):
        index.flush(spark.range(k * 1000, k * 1000 + 4000).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")))
    index.compact()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (path, _, _), = index.runs
    import glob

    ranges = []
    for f in glob.glob(urlsplit(path).path + "/*.parquet"):
        values = pq.read_table(f)["digest"].to_pylist()
        if values:
            assert values == sorted(values)
            stats = pq.ParquetFile(f).metadata.row_group(0).column(0).statistics
            assert bytes(stats.min) == values[0] and bytes(stats.max) == values[-1]
            ranges.append((values[0], values[-1]))
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_filters_follow_their_digests(spark):
    """All known digests pass, and about one in FILTER_RATIO of the others, whatever the number."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")
    for n in (10, 3000, 60_000):
        known = DigestFilter(spark.range(n).select(digest), n)
        passed = known.probe(spark.range(2 * n).select("id", digest))
        assert passed.filter(F.col("id") < n).count() == n
        assert passed.filter(F.col("id") >= n).count() < n * 0.1 + 5
        assert known.pages == -(-n * 16 // 32768)


@pytest.mark.parametrize("rows_each", [3, 20, 60])
def test_several_memtables(documents, rows_each):
    rows = [(i, f"text {i % 23 if i % 2 else i}") for i in range(80)] + [(None, "text 1"), (7, "text 7")]
    assert result(exact_dedup(documents(rows), memtable_rows=rows_each)) == brute(rows)
    weak = lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1)
    assert result(exact_dedup(documents(rows), digest=weak, memtable_rows=rows_each)) == brute(rows)


def test_digests_that_no_filter_knows_meet_no_join(spark):
    """Of three memtables, only the entries of digests that were hits are gathered from the runs."""
    index = DigestIndex(spark)
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")
    parts = [spark.range(0, 3000), spark.range(2900, 6000), spark.range(6000, 9000)]
    found = [index.flush(p.select("id", digest)) for p in parts]
    hits = found[0].unionByName(found[1]).unionByName(found[2]).distinct()
    # 100 digests occur twice; a filter passes about one in FILTER_RATIO of the others.
    assert 100 <= hits.count() <= 100 + 6000 * 0.12
    groups = index.groups_of(hits)
    assert groups.count() == 100 and {r.n for r in groups.collect()} == {2}
    known = DigestFilter(hits)
    entries = sum(known.probe(index._read(path)).count() for path, _, _ in index.runs)
    assert entries <= 9000 * 0.25


def test_one_memtable_has_no_filter_of_its_run(documents):
    index_runs = []
    import shelfspark.llm.exact_dedup as module

    made = module.DigestFilter.__init__

    def counted(self, *args, **more):
        made(self, *args, **more)
        index_runs.append(self)

    module.DigestFilter.__init__ = counted
    try:
        exact_dedup(documents(ROWS)).count()
    finally:
        module.DigestFilter.__init__ = made
    assert sum(f._table is not None for f in index_runs) == 1


def test_ordinary_table_goes_through_several_memtables(documents, monkeypatch):
    """Without any parameter: runs are flushed, filters of earlier runs probed, and runs merged."""
    import shelfspark.llm.exact_dedup as module

    monkeypatch.setattr(module, "LEAST_ROWS", 10)
    seen = []
    flush, merge, probe = DigestIndex.flush, DigestIndex._merge, DigestFilter.probe
    monkeypatch.setattr(DigestIndex, "flush", lambda self, *a, **k: (seen.append("flush"), flush(self, *a, **k))[1])
    monkeypatch.setattr(DigestIndex, "_merge", lambda self, count: (seen.append("merge"), merge(self, count))[1])
    monkeypatch.setattr(DigestFilter, "probe", lambda self, rows: (seen.append("probe"), probe(self, rows))[1])
    rows = [(i, f"text {i % 23 if i % 2 else i}") for i in range(80)] + [(None, "text 1"), (7, "text 7")]
    assert result(exact_dedup(documents(rows))) == brute(rows)
    assert seen.count("flush") == 4 and seen.count("merge") == 3 and seen.count("probe") >= 4
    assert [module.memtable_size(n) for n in (0, 40, 41, 1 << 30)] == [10, 10, 11, 1 << 26]
