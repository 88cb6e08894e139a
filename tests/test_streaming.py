from __future__ import annotations

from pyspark.sql import functions as F
from shelfspark.operators.favorites import toggled_set
from shelfspark.streaming import event_time
from shelfspark.streaming.favorites import parity_stream, toggle_stream


def clicks(df):
    return df.filter("event_type = 'click'").select("user_id", (F.col("event_id") % 40).alias("item"), F.col("event_id").alias("seq"))


def events_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_toggle_stream_equals_batch(spark, sf_dir, tmp_path):
    stream = clicks(events_stream(spark, sf_dir, tmp_path))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = toggle_stream(stream).writeStream.outputMode("update").format("memory").queryName("sets").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert run.awaitTermination(180)
    finally:
        spark.conf.unset(provider)
    got = {r.user_id: r["items"] for r in spark.table("sets").collect()}
    batch = {}
    for r in toggled_set(clicks(spark.read.parquet(f"{sf_dir}/events.parquet"))).orderBy("user_id", "place").collect():
        batch.setdefault(r.user_id, []).append(r["item"])
    assert {u: x for u, x in got.items() if x} == batch and sum(map(len, batch.values())) == 152


def test_parity_stream(spark, sf_dir, tmp_path):
    stream = clicks(events_stream(spark, sf_dir, tmp_path))
    run = parity_stream(stream).writeStream.outputMode("complete").format("memory").queryName("parity").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    assert spark.table("parity").count() == 152


def timed(spark, rows):
    """Events from (user, microseconds after a moment, seq, item)."""
    df = spark.createDataFrame(rows, "user_id bigint, us bigint, seq bigint, item bigint")
    return df.select("user_id", F.timestamp_micros(F.col("us") + 1_700_000_000_000_000).alias("ts"), "seq", "item")


def in_batches(spark, batches, tmp_path):
    """A stream with one micro-batch for each list of rows, and a closing row."""
    for k, rows in enumerate([*batches, [(0, 10**15, 0, 0)]]):
        timed(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    return spark.readStream.schema(timed(spark, [(1, 1, 1, 1)]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def sets_of(rows):
    """The set of each user after toggles by (time, seq)."""
    out = {}
    for user, _, _, item in sorted(rows, key=lambda r: (r[1], r[2])):
        items = out.setdefault(user, [])
        items.remove(item) if item in items else items.append(item)
    return out


def quiet_of(rows, quiet):
    out = set()
    for user in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == user)
        out |= {(user, seq) for (at, seq), (following, _) in zip(own, [*own[1:], (10**18, 0)]) if following - at >= quiet}
    return out


def newest(df):
    return {r.user_id: r.items_ for r in df.groupBy("user_id").agg(F.max_by("items", "toggles").alias("items_")).collect()}


def test_toggles_by_event_time(spark, tmp_path):
    """Rows that come after later ones, ties in time, and a row that is later than the watermark allows."""
    second = 1_000_000
    first = [(1, 5 * second, 1, 7), (1, 9 * second, 2, 8), (2, 5 * second, 3, 7), (2, 5 * second, 4, 9)]
    then = [(1, 7 * second, 5, 7), (1, 3 * second, 6, 8), (2, 5 * second, 2, 9), (3, 8 * second, 9, 1), (1, 20 * second, 10, 6)]
    more = [(3, 21 * second, 12, 2), (1, 12 * second, 13, 6)]
    more.append((None, 13 * second, 20, 6))
    # The batch before was released up to 10 seconds.
    last = [(3, 40 * second, 14, 1), (1, second, 11, 99)]
    stream = in_batches(spark, [first, then, more, last], tmp_path)
    found = event_time.run_to_end(event_time.ordered_toggles(stream, "10 seconds"), "toggles")
    kept = [r for r in first + then + more + last if r[0] and r[3] != 99]
    assert newest(found) == sets_of(kept)
    assert found.filter("user_id is null").count() == 0


def test_debounce_by_event_time(spark, tmp_path):
    milli = 1000
    first = [(1, 0, 1, 0), (1, 400 * milli, 2, 0), (2, 10 * milli, 3, 0), (1, 900 * milli, 8, 0)]
    then = [(1, 200 * milli, 4, 0), (1, 649 * milli, 5, 0), (1, 650 * milli, 6, 0), (2, 260 * milli, 7, 0), (2, 260 * milli, 9, 0)]
    stream = in_batches(spark, [first, then], tmp_path)
    found = event_time.run_to_end(event_time.quiet_events(stream, "2 seconds", 250), "quiet")
    assert {(r.user_id, r.seq) for r in found.collect()} == quiet_of(first + then, 250 * milli)


def test_shuffled_events_equal_batch(spark, sf_dir):
    """Replayed out of order, a user's toggles and quiet events are those of the whole table."""
    from shelfspark.operators.favorites import debounced

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("item"))
    found = event_time.run_to_end(event_time.ordered_toggles(event_time.replayed(rows, "t"), "10 days"), "t")
    want = sets_of([(r.user_id, r.ts, r.seq, r["item"]) for r in rows.collect()])
    assert newest(found) == want and found.agg(F.sum("toggles")).first()[0] >= rows.count()
    quiet = event_time.run_to_end(event_time.quiet_events(event_time.replayed(rows.drop("item"), "q"), "10 days", 7_200_000), "q")
    batch = debounced(rows, 7_200_000)
    assert {r.seq for r in quiet.collect()} == {r.seq for r in batch.collect()} and 0 < batch.count() < rows.count()


def test_empty_stream(spark):
    rows = timed(spark, [(1, 1, 1, 1)]).limit(0)
    assert event_time.run_to_end(event_time.ordered_toggles(event_time.replayed(rows, "e"), "1 day"), "e").count() == 0


def test_groups_of_users_keep_their_rows_apart(spark, tmp_path, monkeypatch):
    """The state has a key for each group, not for each user; sets grow and empty over several releases."""
    import random

    monkeypatch.setattr(event_time, "GROUPS", 2)
    rng, second = random.Random(3), 1_000_000
    batches = [[(rng.randrange(40), second * (30 * k + rng.randrange(40)), 1000 * k + j, rng.randrange(4)) for j in range(250)] for k in range(3)]
    every = sum(batches, [])
    sizes = []
    for name, stream, want in (("sets", lambda s: event_time.ordered_toggles(s, "20 seconds"), None), ("quiet", lambda s: event_time.quiet_events(s, "20 seconds", 3000), quiet_of(every, 3 * second))):
        found = event_time.run_to_end(stream(in_batches(spark, batches, tmp_path / name)), name)
        if want is None:
            assert newest(found) == sets_of(every) and found.count() > 40
        else:
            assert {(r.user_id, r.seq) for r in found.collect()} == want
        sizes.append(found.count())
    assert all(sizes)


def test_micro_batches_do_not_grow_with_files(spark, tmp_path):
    """A folder of replayed() is one micro-batch, however many files the table has."""
    rows = timed(spark, [(u % 7, 1000 * u, u, 0) for u in range(600)]).repartition(30).drop("item")
    found = event_time.replayed(rows, "f").writeStream.format("memory").queryName("replayed_files").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert found.awaitTermination(120)
    assert spark.table("replayed_files").count() == 601
    assert sum(p["numInputRows"] > 0 for p in found.recentProgress) <= 7
