"""Queries over what is kept between passes: generations, profiles, fingerprints that sources share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .operators import index, parts
from .registry import query, read


@query("""
WITH o AS (SELECT o_orderkey AS k, 's' || o_custkey % 3 AS source FROM orders)
SELECT source, CASE WHEN source = 's2' THEN (CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END) WHEN k % 5 = 0 THEN 3 ELSE 2 END::BIGINT AS generation, count(*) AS "rows" FROM o
WHERE source = 's2' OR k % 7 <> 0 GROUP BY ALL""")
def index_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after a complete listing of two sources that misses some items, and one cut off that meets a fifth (H3)."""
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("source"), F.col("o_orderkey").alias("key"), F.lit(1).cast("long").alias("generation"))
    second = rows.where("source <> 's2' AND key % 7 <> 0")
    kept = index.sweep(rows, second, 2, complete=True)
    return index.sweep(kept, rows.where("key % 5 = 0"), 3, complete=False).groupBy("source", "generation").agg(F.count("*").alias("rows"))


@query("""
SELECT o_custkey AS source, o_orderpriority AS reader, o_orderstatus AS kind, count(*) AS "rows", 1::BIGINT AS profiles FROM orders GROUP BY ALL""")
def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards that number their profiles themselves, merged: rows find what they were read with, each profile once (H8)."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("key"), F.lit("m").alias("marker"), F.lit(1).cast("long").alias("generation"), F.col("o_orderpriority").alias("reader"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 2).alias("shard"))
    body = ["reader", "kind"]
    from pyspark.sql import Window

    local = orders.select("shard", *body).distinct().withColumn("profile", F.row_number().over(Window.partitionBy("shard").orderBy(F.when(F.col("shard") == 0, F.col("reader")).otherwise(F.reverse("reader")), "kind")))
    rows = orders.join(local, ["shard", *body]).select("shard", "source", "key", "marker", "generation", "profile")
    merged, profiles = index.merge_shards(rows, local, body)
    _, once = index.split_profiles(orders.select("source", "key", *body), body)
    found = merged.join(profiles.join(once.select("profile"), "profile", "left_semi"), "profile")
    seen = profiles.groupBy("reader", "kind").agg(F.count("*").alias("profiles"))
    return found.groupBy("source", "reader", "kind").agg(F.count("*").alias("rows")).join(seen, ["reader", "kind"])


@query("""
WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, md5(text) AS f FROM documents),
p AS (SELECT f, source, doc_id AS key, CASE WHEN doc_id % 10 = 0 THEN 'moved' WHEN doc_id % 11 = 0 THEN 'gone' WHEN doc_id % 13 = 0 THEN 'old' END AS now FROM d WHERE doc_id % 2 = 0 AND f IS NOT NULL),
good AS (SELECT * FROM p WHERE now IS NULL)
SELECT d.doc_id, min(CASE WHEN g.source <> d.source THEN g.source END) AS original_source,
  arg_min(CASE WHEN g.source <> d.source THEN g.key END, CASE WHEN g.source <> d.source THEN (g.source, g.key) END) FILTER (WHERE g.source <> d.source) AS original_key,
  (SELECT count(*) FROM p WHERE now IN ('moved', 'gone')) AS dropped
FROM d LEFT JOIN good AS g USING (f) GROUP BY d.doc_id""")
def shared_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies whose original is in another source, by fingerprints that sources share; originals that have moved, are
    gone or were read with an older build are none (H1)."""
    k = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), k.alias("key"), F.md5("text").alias("fingerprint"), k)
    pointers = docs.where((k % 2 == 0) & F.col("fingerprint").isNotNull()).select("fingerprint", "source", "key")
    rows = docs.where((k % 11 != 0) | (k % 10 == 0)).select("source", "key", F.when(k % 10 == 0, F.md5(F.concat(F.lit("x"), k.cast("string")))).otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(0).alias("flags"), F.when(k % 13 == 0, "p1").otherwise("p2").alias("profile"))
    sources = [r[0] for r in docs.select("source").distinct().limit(10_000).collect()]
    found, left = index.originals(docs.select("source", "key", "fingerprint"), pointers, rows, sources, ["p2"])
    dropped = pointers.agg(F.count("*").alias("_a")).crossJoin(left.agg(F.count("*").alias("_b"))).select((F.col("_a") - F.col("_b")).alias("dropped"))  # one row each
    return found.select(F.col("key").alias("doc_id"), F.col("original.source").alias("original_source"), F.col("original.key").alias("original_key")).crossJoin(dropped)


@query("""
WITH k AS (SELECT o_orderkey AS k, o_custkey AS c, (k % 11 = 0 OR k % 5 = 0 OR k % 7 = 0) AND k % 17 <> 0 AS reads FROM orders)
SELECT k || '/card' AS id, CASE WHEN reads AND k % 11 = 0 THEN 'f' WHEN reads AND k % 2 = 0 THEN 'b' ELSE 'c' END || c AS location, CASE WHEN reads AND k % 11 = 0 THEN 2 ELSE 1 END AS first_seen FROM k WHERE reads OR k % 11 <> 0
UNION ALL SELECT k || '/pin', 'b' || c, 1 FROM k WHERE NOT reads AND k % 11 <> 0 AND k % 2 = 0
UNION ALL SELECT k || '/body', 'c' || c, 1 FROM k WHERE k % 13 = 0""")
def replaced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of items and their attachments after a pass over the attachments in two stretches: new, changed and outdated ones are read
    again, those too large aren't; their findings are replaced, all others and the bodies' stay (H5, H6)."""
    k = F.col("k")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("string").alias("c"), F.lit("s").alias("source"), F.col("o_orderkey").cast("string").alias("part"))
    finding = lambda rows, part, cls, place: rows.select("source", part.alias("part"), F.concat(k.cast("string"), F.lit("/" + cls)).alias("id"), F.concat(F.lit(place), "c").alias("location"), F.lit(1).alias("first_seen"))
    had = orders.where(k % 11 != 0)
    kept = finding(had, F.col("part"), "card", "c").unionByName(finding(had.where(k % 2 == 0), F.col("part"), "pin", "b")).unionByName(finding(orders.where(k % 13 == 0), F.lit(None).cast("string"), "body", "c"))
    known = had.select("source", "part", F.lit("m").alias("marker"), F.when(k % 7 == 0, "p0").otherwise("p1").alias("profile"))
    listing = orders.select("source", "part", F.when(k % 5 == 0, "m2").otherwise("m").alias("marker"), F.when(k % 17 == 0, 1000).otherwise(100).alias("size"), F.col("part").alias("sample"))
    total = listing.count()
    for budget in (total // 5, total):  # the first stretch is cut off by its budget
        now = shared.written(parts.stretch(parts.stale(listing, known, "p1", max_bytes=500), max(budget, 1), 1 << 60), "parts")
        new = now.join(orders.select("source", "part", "c"), ["source", "part"]).select("source", "part", F.concat("part", F.lit("/card")).alias("id"), F.concat(F.lit("f"), "c").alias("fallback"))
        kept, known = shared.written(parts.replaced(kept, now, new, 2), "kept"), shared.written(parts.recorded(known, now, "p1"), "known")
    return kept.select("id", "location", "first_seen")
