"""The favorites log: versions, repeated batches, snapshots, and what is read as of each version."""

from __future__ import annotations

import os
import random

import pytest
from shelfspark.sources.favorites_log import FavoritesLog

SCHEMA = "user_id bigint, item bigint, seq bigint"


def made(seed, batches=5, rows=30):
    rng, seq, out = random.Random(seed), 0, []
    for _ in range(batches):
        batch = []
        for _ in range(rows):
            seq += 1
            batch.append((rng.randrange(4), rng.randrange(6), seq))
        out.append(batch)
    return out


def sets_of(batches):
    out = {}
    for user, item, _ in sorted((r for b in batches for r in b), key=lambda r: r[2]):
        items = out.setdefault(user, [])
        items.remove(item) if item in items else items.append(item)
    return {u: x for u, x in out.items() if x}


def read(log, version=None):
    out = {}
    for r in log.as_of(version).orderBy("user_id", "place").collect():
        out.setdefault(r.user_id, []).append(r["item"])
    return out


@pytest.fixture()
def log(spark, tmp_path):
    return FavoritesLog(spark, f"file://{tmp_path}/log")


def fill(spark, log, batches):
    for k, batch in enumerate(batches):
        log.append(spark.createDataFrame(batch, SCHEMA), k)


def test_as_of_every_version(spark, log):
    batches = made(1)
    fill(spark, log, batches)
    for k in range(len(batches)):
        assert read(log, k) == sets_of(batches[: k + 1])
    assert read(log) == sets_of(batches) and log.latest() == 4


def test_a_batch_that_comes_again_counts_once(spark, log):
    batches = made(2)
    fill(spark, log, batches)
    for k in (4, 2, 4):
        log.append(spark.createDataFrame(batches[k], SCHEMA), k)
    assert read(log) == sets_of(batches)


def test_snapshots_change_nothing(spark, log):
    batches = made(3, 6)
    fill(spark, log, batches[:4])
    log.compact(2)
    fill_from = {k: read(log, k) for k in range(4)}
    log.compact()
    log.append(spark.createDataFrame(batches[1], SCHEMA), 1)
    log.append(spark.createDataFrame(batches[4], SCHEMA), 4)
    log.append(spark.createDataFrame(batches[5], SCHEMA), 5)
    assert log._versions("snapshot") == [2, 3]
    assert all(read(log, k) == fill_from[k] == sets_of(batches[: k + 1]) for k in range(4))
    assert read(log) == sets_of(batches)


def test_an_unfinished_version_is_not_read(spark, log, tmp_path):
    batches = made(4, 3)
    fill(spark, log, batches)
    os.remove(tmp_path / "log/log/version=2/_SUCCESS")
    assert log.latest() == 1 and read(log) == sets_of(batches[:2])
    log.append(spark.createDataFrame(batches[2], SCHEMA), 2)
    assert read(log) == sets_of(batches)


def test_empty_log_and_empty_batch(spark, log):
    assert log.latest() is None and read(log) == {}
    log.compact()
    log.append(spark.createDataFrame([], SCHEMA), 0)
    assert read(log) == {} and log.latest() == 0


def test_a_stream_that_starts_again(spark, log, tmp_path):
    """What was appended before a restart is not appended twice."""
    batches = made(5, 3)
    source = tmp_path / "in"
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    for k, batch in enumerate(batches[:2]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    assert log.write_stream(stream(), str(tmp_path / "c")).awaitTermination(120)
    assert read(log) == sets_of(batches[:2])
    spark.createDataFrame(batches[2], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    assert log.write_stream(stream(), str(tmp_path / "c")).awaitTermination(120)
    assert read(log) == sets_of(batches) and log.latest() == 2


def test_a_batch_that_is_read_from_the_log_itself(spark, log):
    batches = made(6, 3)
    fill(spark, log, batches)
    log.append(spark.read.parquet(f"{log.path}/log/version=2"), 2)
    assert read(log) == sets_of(batches) and log._versions("log") == [0, 1, 2]
