"""Rows kept between passes, and joins in which one key has half of all rows."""

from pyspark.sql import functions as F

from veilsight.operators import incremental, index
from veilsight.operators.joins import attach


def test_hot_keys_are_dealt_out(spark):
    keys = [None] * 300 + ["hot"] * 1000 + [f"k{i}" for i in range(700)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string").repartition(8)
    one = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    adaptive, parts = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "20"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        out = attach(rows, one, ["k"], "n", share=100)
        each = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert max(r.n for r in each) <= len(keys) // 10  # no task has a tenth of the rows, though one key has half
        got = {r.id: r["first"] for r in out.collect()}
    finally:
        for name, value in (("spark.sql.adaptive.enabled", adaptive), ("spark.sql.shuffle.partitions", parts), ("spark.sql.autoBroadcastJoinThreshold", limit)):
            spark.conf.set(name, value)
    assert out.columns == ["id", "k", "first"] and got == {i: None if k is None else keys.index(k) for i, k in enumerate(keys)}
    assert attach(rows.limit(0), one.limit(0), ["k"], "n").count() == 0


def test_copies_of_a_hot_content(spark):
    items = spark.createDataFrame([(i, "same" if i % 2 else None if i % 3 == 0 else f"t{i}") for i in range(60)], "id int, text string")
    got = {r.id: r.duplicate_of for r in incremental.duplicates(items, F.col("text"), "id").collect()}
    assert got == {i: 1 if i % 2 and i > 1 else None for i in range(60)}


BODY = ["adapter", "readers"]


def test_merged_shards_equal_one_build(spark):
    kind = "source string, key int, marker string, generation long, adapter string, readers array<struct<key:string,value:string>>"
    data = [("a", i, f"m{i}", 1, "pdf" if i % 3 else "text", [("r", str(i % 2))] if i % 4 else []) for i in range(24)]
    rows = spark.createDataFrame(data, kind)
    want, profiles = index.split_profiles(rows, BODY)
    shards = []
    for shard in range(2):  # each numbers its profiles in an order of its own
        mine = [d for d in data if d[1] % 2 == shard]
        found = sorted({(d[4], tuple(d[5])) for d in mine}, reverse=bool(shard))
        shards += [((shard, *d[:4], found.index((d[4], tuple(d[5])))), [(shard, n, a, list(r)) for n, (a, r) in enumerate(found)]) for d in mine]
    local = {str(p): p for _, ps in shards for p in ps}
    numbered = spark.createDataFrame([r for r, _ in shards] + [(1, "a", 3, "older", 0, 0), (0, "lost", 99, "m", 1, 77)], "shard int, source string, key int, marker string, generation long, profile int")
    merged, once = index.merge_shards(numbered, spark.createDataFrame(list(local.values()), "shard int, profile int, adapter string, readers array<struct<key:string,value:string>>"), BODY)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(merged.where("source = 'a'")) == key(want) and key(once) == key(profiles)
    assert merged.where("source = 'lost'").first().profile is None
    assert index.sorted_map is not None and spark.range(1).select(index.sorted_map(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("m")).first().m[0].key == "a"


def test_sweep_relist_and_forget(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "source string, key int, generation long")
    listed = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 9, "x")], "source string, key int, marker string")
    assert sorted(map(tuple, index.sweep(rows, listed, 2, True).collect())) == [("a", 1, 2), ("b", 1, 1)]
    assert sorted(map(tuple, index.sweep(rows, listed, 2, False).collect())) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]
    assert index.sweep(rows, listed.limit(0), 2, True).count() == 3
    cursors = spark.createDataFrame([("a", "s3", "1", "k7", 5), ("b", "s3", None, "k8", 6), ("c", "sql", "1", "t", 7), ("d", None, "1", "p", 8)], "source string, kind string, listing string, start_after string, findings int")
    got = {r.source: (r.listing, r.start_after, r.findings, r.relisted) for r in index.relist(cursors, {"s3": "2", "sql": "1"}, ["start_after"]).collect()}
    assert got == {"a": ("2", None, 5, True), "b": ("2", "k8", 6, False), "c": ("1", "t", 7, False), "d": ("1", "p", 8, False)}
    assert sorted(r.source for r in index.forget(cursors, rows).collect()) == ["a", "b"]


def test_a_moved_original_is_no_original(spark):
    kind = "source string, key int, fingerprint string, flags int, profile string"
    rows = spark.createDataFrame([("a", 1, "f", 0, "p"), ("b", 2, "f", 0, "p"), ("b", 3, "g", 0, "p"), ("b", 5, "h", 16, "p"), ("b", 6, "i", 0, "old")], kind)
    kept = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("g2", "b", 3), ("x", "b", 4), ("h", "b", 5), ("i", "b", 6)], "fingerprint string, source string, key int")
    items = spark.createDataFrame([("a", 10, "f"), ("c", 11, "f"), ("c", 12, "g2"), ("c", 13, "x"), ("c", 14, "h"), ("c", 15, "i"), ("c", 16, None)], "source string, key int, fingerprint string")
    found, left = index.originals(items, kept, rows, ["a", "b"], ["p"])
    assert {r.key: r.original and tuple(r.original) for r in found.collect()} == {10: ("b", 2), 11: ("a", 1), 12: None, 13: None, 14: None, 15: None, 16: None}
    assert sorted(r.fingerprint for r in left.collect()) == ["f", "f", "h", "i"]
    assert {r.key: r.original and r.original.source for r in index.originals(items, kept, rows, ["b"], ["p"])[0].collect()}[11] == "b"
    assert sorted(map(tuple, index.pointers(rows).collect())) == [("f", "a", 1), ("f", "b", 2), ("g", "b", 3), ("i", "b", 6)]


def test_items_with_parts(spark):
    from veilsight.operators import parts

    listing = spark.createDataFrame([("s", "a", "m", 5), ("s", "a", "m", 5), ("s", "b", "m2", 5), ("s", "c", None, 5), ("s", "big", "m", 99), ("s", "none", "m", 0), ("s", None, "m", 5), ("s", "old", "m", 5)], "source string, part string, marker string, size int").withColumn("sample", F.lit("x"))
    known = spark.createDataFrame([("s", "b", "m", "p"), ("s", "c", None, "p"), ("s", "old", "m", "p0"), ("s", "gone", "m", "p"), ("t", "gone", "m", "p")], "source string, part string, marker string, profile string")
    due = parts.stale(listing, known, "p", max_bytes=50)
    assert {(r.part, r.why) for r in due.collect()} == {("a", "new"), ("b", "changed"), ("old", "profile")}
    assert parts.stale(listing, known, "p", percent=0).count() == 0 and [r.part for r in parts.stretch(due, 1, 100).collect()] == ["a"]
    kept = spark.createDataFrame([("s", "b", "1", "l2", 1), ("s", "b", "2", "l1", 1), ("s", None, "body", "l1", 1), ("t", "b", "1", "l9", 1)] + [("s", "hot", str(i), "h", 1) for i in range(3000)], "source string, part string, id string, location string, first_seen int")
    new = spark.createDataFrame([("s", "b", "2", "f"), ("s", "b", "3", "f"), ("s", "a", "4", "f")] + [("s", "hot", str(i), "f") for i in range(1500, 4000)], "source string, part string, id string, fallback string")
    hot = due.select("source", "part").unionByName(spark.createDataFrame([("s", "hot")], "source string, part string"))
    got = {tuple(r) for r in parts.replaced(kept, hot, new, 2).collect()}
    want = {("s", "b", "2", "l1", 1), ("s", "b", "3", "l1", 2), ("s", "a", "4", "f", 2), ("s", None, "body", "l1", 1), ("t", "b", "1", "l9", 1)}
    assert got == want | {("s", "hot", str(i), "h", 1 if i < 3000 else 2) for i in range(1500, 4000)}
    assert parts.replaced(kept.limit(0), hot, new.limit(0), 2).count() == 0
    after = {(r.source, r.part, r.marker, r.profile) for r in parts.recorded(known, due, "p", listing).collect()}
    assert after == {("s", "a", "m", "p"), ("s", "b", "m2", "p"), ("s", "c", None, "p"), ("s", "old", "m", "p"), ("t", "gone", "m", "p")}
