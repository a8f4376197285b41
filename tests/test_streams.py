"""Streams with state: whatever is run again, cut off or cut otherwise gives the same."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veilsight import shared
from veilsight.operators import conversation
from veilsight.streaming import conversations, late, sessions, versions

T0 = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC).replace(tzinfo=None)
at = lambda minutes: T0 + datetime.timedelta(minutes=minutes)


def test_versions_show_whole_writes_only(spark, tmp_path):
    v = versions.Versions(spark, f"file://{tmp_path}/v", "n int")
    assert v.read().count() == 0 and v.last() is None
    v.write(spark.range(3).select(F.col("id").cast("int").alias("n")), 0)
    (tmp_path / "v" / "version=1").mkdir()  # a write that was cut off
    assert v.numbers() == [0] and v.read().count() == 3 and v.read(0).count() == 0
    v.write(spark.range(5).select(F.col("id").cast("int").alias("n")), 1)
    assert v.read().count() == 5 and v.read(1).count() == 3 and v.all().count() == 8


def test_changes_applied_again_change_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, seq long, v string").schema
    table = versions.BucketTable(spark, f"file://{tmp_path}/t", schema, ["k"], buckets=3)
    table.create(spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (None, 0, "n")], schema))
    change = "k long, seq long, v string, deleted boolean"
    first = spark.createDataFrame([(1, 5, "a5", False), (1, 4, "a4", False), (3, 1, "c", False)] + [(7, i, f"hot{i}", False) for i in range(50)], change)
    second = spark.createDataFrame([(2, 9, None, True), (None, 9, None, True), (7, 60, None, True), (3, 2, "c2", None)], change)
    table.apply(first, 0, "seq")
    one = sorted(map(tuple, table.read().collect()), key=str)
    table.apply(second, 1, "seq")
    two = sorted(map(tuple, table.read().collect()), key=str)
    assert one == sorted([(1, 5, "a5"), (2, 0, "b"), (3, 1, "c"), (7, 49, "hot49"), (None, 0, "n")], key=str) and two == [(1, 5, "a5"), (3, 2, "c2")]
    table.apply(second, 1, "seq")  # a batch that is run again
    assert sorted(map(tuple, table.read().collect()), key=str) == two
    table.apply(first.limit(0), 2, "seq")
    assert sorted(map(tuple, table.read().collect()), key=str) == two


def test_late_events_are_kept_beside(spark, tmp_path):
    batches = [[(1, at(0)), (2, at(30))], [(3, at(29)), (4, at(19)), (5, None)], [(6, at(25)), (7, at(100))]]
    schema = spark.createDataFrame([], "id long, ts timestamp").schema
    split = late.LateSplit(spark, f"file://{tmp_path}/l", schema, delay="10 minutes")
    for n, rows in enumerate(batches):
        for _ in range(2):  # each batch twice
            split.apply(spark.createDataFrame(rows, schema), n)
    assert sorted(r.id for r in split.late.all().collect()) == [4, 5] and sorted(r.id for r in split.kept.all().collect()) == [1, 2, 3, 6, 7]


def test_interrupted_pass_loses_and_repeats_nothing(spark, tmp_path):
    rows = [(f"k{i}", "m", at(i), 1) for i in range(10)]
    listing = lambda rows: spark.createDataFrame(rows, "key string, marker string, modified timestamp, size int")
    fresh = lambda: late.Passes(spark, f"file://{tmp_path}/p", skew="3 minutes")
    chunk = fresh().chunk(listing(rows), F.lit(at(20)), "size", 4, 100)
    first = sorted(r.key for r in chunk.collect())
    again = fresh().chunk(listing(rows), F.lit(at(21)), "size", 4, 100)  # the first was never committed
    assert first == sorted(r.key for r in again.collect()) == ["k0", "k1", "k2", "k3"]
    fresh().commit(again)
    p = fresh()
    seen = list(first)
    while (chunk := p.chunk(listing(rows), F.lit(at(22)), "size", 4, 100)) is not None:
        seen += [r.key for r in chunk.collect()]
        p.commit(chunk)
    assert sorted(seen) == [f"k{i}" for i in range(10)]
    p.complete()
    # listed late, within the skew of the pass's beginning (minute 20); one older; one read again under another marker
    more = [*rows, ("late", "m", at(18), 1), ("old", "m", at(2), 1), ("k9", "m2", at(19), 1)]
    assert sorted(r.key for r in fresh().chunk(listing(more), F.lit(at(40)), "size", 9, 100).collect()) == ["k9", "late"]


@pytest.mark.parametrize("cuts", [[4, 12], [1, 7, 12]])
def test_sessions_whatever_the_cut(spark, cuts):
    minutes = [0, 5, 3, 50, 55, 52, 60, 130, 131, 128, 200, 2000]  # out of order by up to three minutes
    rows = [(i, "a" if i % 3 else "b", at(m)) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "item long, key string, ts timestamp")
    path, begin = shared.new_path(spark, "t"), 0
    for end in cuts:
        df.where(f"item >= {begin} AND item < {end}").coalesce(1).write.mode("append").parquet(path)
        begin = end
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = shared.new_path(spark, "o")
    with sessions.rocksdb(spark):
        found = sessions.turns(stream, "key", "item", gap=1800, late="10 minutes")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared.new_path(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(out).collect()))
    want = sorted(tuple(r) for r in sessions.turns_of_table(df, "key", "item", gap=1800).collect() if r.item != 11)  # the last event waits
    assert got == want


def _talks(seed, most=24):
    """Conversations of phrases that arm, end, go on and are keyed, at random."""
    r = random.Random(seed)
    asks = ["Your card number?", "your pin please", "Account number please", "What is your date of birth?", "Sorry, I didn't get that", "Press one for more.", "ok", "mm-hmm", "", None]
    says = ["4539 1488", "0343 6467", "4539 1488 0343 6467", "one two", "3", "123", "12 and 34", "well", "my card is 4539", "078 05", "05/06/1985", "", None]
    turns = []
    for c in range(40):
        now = 0
        for t in range(r.randrange(1, most)):
            who = r.choice(["customer", "customer", "customer", "bot", "agent"])
            now += r.choice([500, 1000, 3000, 16_000])
            begin = r.choice([now, now, now, None])
            turns.append((f"c{c}", t, who, r.choice(says if who == "customer" or r.random() < 0.3 else asks), r.choice(["speech", "dtmf", None]), begin, None if begin is None else begin + 200))
    return turns


_TURN = "conv_id string, turn int, speaker string, text string, channel string, begin_ms long, end_ms long"


@pytest.mark.parametrize("seed, cuts", [(1, 2), (2, 3)])
def test_conversations_whatever_the_cut(spark, tmp_path, seed, cuts):
    turns, r = _talks(seed), random.Random(seed)
    want = conversation.classify(spark.createDataFrame(turns, _TURN), 2026).collect()
    assert len(want) > 30 and any(len(v.parts) > 2 for v in want)
    batches = [[] for _ in range(cuts)]
    for c in {t[0] for t in turns}:
        own = [t for t in turns if t[0] == c]
        places = sorted(r.randrange(cuts) for _ in own)
        for t, b in zip(own, places, strict=True):
            batches[b].append(t)
    stream = conversations.Conversations(spark, f"file://{tmp_path}/c", 2026)
    for n, rows in enumerate(batches):
        stream.apply(spark.createDataFrame(rows, _TURN), n)
        if n == 1:  # a batch that is run again
            stream.apply(spark.createDataFrame(rows, _TURN), n)
    most = stream.held.read().groupBy("conv_id").count().agg({"count": "max"}).first()[0]
    stream.finish()
    assert sorted(map(str, stream.findings().collect())) == sorted(map(str, want))
    assert most < 24 and stream.held.read().count() == 0 and stream.late.all().count() == 0


def test_conversations_late_and_idle(spark, tmp_path):
    rows = lambda *turns: spark.createDataFrame(turns, _TURN)
    stream = conversations.Conversations(spark, f"file://{tmp_path}/c", 2026, idle_ms=60_000)
    stream.apply(rows(("a", 0, "bot", "Your pin?", None, 0, 10), ("a", 1, "customer", "12", None, 20, 30), ("b", 0, "bot", "Your pin?", None, 0, 10)), 0)
    assert stream.findings().count() == 0  # the customer may go on
    stream.apply(rows(("a", 1, "customer", "99", None, 40, 50), ("a", None, "customer", "98", None, 40, 50), ("a", 2, "customer", "34", None, 60, 70)), 1)
    assert sorted(r.text for r in stream.late.all().collect()) == ["98", "99"]
    stream.apply(rows(("z", 0, "bot", "hello", None, 100_000, 100_010)), 2)  # a and b are over
    got = stream.findings().collect()
    assert [(v.conv_id, v.turn, v.end_turn, v.cls) for v in got] == [("a", 1, 2, "pin")] and [r.conv_id for r in stream.held.read().collect()] == ["z"]
    stream.apply(rows(), 3)
    assert [r.conv_id for r in stream.held.read().collect()] == ["z"]
