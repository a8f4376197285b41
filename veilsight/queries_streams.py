"""Queries over streams with state: tables as micro-batches, results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_values, shared
from .registry import ORACLE, query, read
from .streaming import conversations, late, sessions, versions

#: Fixed value: turns from which a micro-batch has one more file.
TURNS_A_FILE = 500_000


def _cut(df: DataFrame, by: str, pieces: int, name: str) -> str:
    """A table as files by ranges of ``by``, which streams read one after the other."""
    spark, path = df.sparkSession, shared.new_path(df.sparkSession, name)
    at = df.select(by).distinct().approxQuantile(by, [k / pieces for k in range(1, pieces)], 0.01)
    for k in range(pieces):
        low, high = (F.lit(True) if k == 0 else F.col(by) > at[k - 1]), (F.lit(True) if k == pieces - 1 else F.col(by) <= at[k])
        df.where(low & high).coalesce(1).write.mode("append").parquet(path)
    return path


def _stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 43200000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS no FROM g)
SELECT user_id AS key, min(t) OVER (PARTITION BY user_id, no) AS begin, (row_number() OVER (PARTITION BY user_id, no ORDER BY t, event_id) - 1)::BIGINT AS turn, t AS "at", event_id::BIGINT AS item FROM s""")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in sessions of each user, read as four micro-batches with state and timers."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    # one event far behind all others moves the watermark over them; it waits for ever itself
    end = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), "ts")
    rows = events.unionByName(end.where("ts IS NOT NULL")).withColumn("_at", F.unix_millis("ts"))
    path, out, state = _cut(rows, "_at", 4, "events"), shared.new_path(spark, "turns"), shared.new_path(spark, "turns-state")
    with sessions.rocksdb(spark):
        found = sessions.turns(_stream(spark, path, rows), "user_id", "event_id", gap=43_200)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query("""
WITH c AS (SELECT user_id, event_id, event_type, value, event_id % 7 = 0 AS deleted, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT c_custkey AS user_id, 0::BIGINT AS event_id, c_mktsegment AS event_type, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)
UNION ALL SELECT user_id, event_id, event_type, value FROM c WHERE r = 1 AND NOT deleted""")
def changed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table under a change feed read as three micro-batches, each applied twice."""
    start = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.col("c_mktsegment").alias("event_type"), F.col("c_acctbal").alias("value"))
    changes = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_id") % 7 == 0).alias("deleted"))
    table = versions.BucketTable(spark, shared.new_path(spark, "changed"), start.schema, ["user_id"], buckets=8)
    table.create(start)

    def twice(batch: DataFrame, number: int) -> None:
        table.apply(batch, number, "event_id")
        table.apply(batch, number, "event_id")

    stream = _stream(spark, _cut(changes, "event_id", 3, "changes"), changes)
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", shared.new_path(spark, "changes-state")).trigger(availableNow=True).start().awaitTermination()
    return table.read()


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN ts - INTERVAL 9 DAY ELSE ts END AS ts, ts AS came FROM events),
b AS (SELECT *, ntile(4) OVER (ORDER BY came, event_id) AS batch FROM e), m AS (SELECT batch, max(ts) AS top FROM b GROUP BY batch)
SELECT ts::DATE::VARCHAR AS day, count(*) FILTER (WHERE NOT late) AS counted, count(*) FILTER (WHERE late) AS late
FROM (SELECT b.*, coalesce(ts < (SELECT max(top) FROM m WHERE m.batch < b.batch) - INTERVAL 1 DAY, false) AS late FROM b) GROUP BY 1""")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, and those that came behind the watermark, of four micro-batches (a tenth comes nine days late)."""
    ts = F.col("ts").cast("timestamp")
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, ts - F.expr("INTERVAL 9 DAYS")).otherwise(ts).alias("ts"), ts.alias("came"))
    # the batches of the SQL: fourths of the events in the order they came
    total, from_, path = rows.count(), 0, shared.new_path(spark, "late-events")
    from .operators.incremental import running_total

    placed = shared.written(running_total(rows.withColumn("o", F.struct("came", "event_id")).withColumn("one", F.lit(1)), "o", ["one"]).select("event_id", "ts", "total_one"), "placed")
    for k in range(4):
        upto = from_ + total // 4 + (1 if k < total % 4 else 0)
        placed.where((F.col("total_one") > from_) & (F.col("total_one") <= upto)).select("event_id", "ts").coalesce(1).write.mode("append").parquet(path)
        from_ = upto
    events = rows.select("event_id", "ts")
    split = late.LateSplit(spark, shared.new_path(spark, "late"), events.schema, delay="1 DAY")
    split.start(_stream(spark, path, events), shared.new_path(spark, "late-state")).awaitTermination()
    both = split.kept.all().withColumn("late", F.lit(False)).unionByName(split.late.all().withColumn("late", F.lit(True)))
    return both.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_if(~F.col("late")).alias("counted"), F.count_if("late").alias("late"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderdate, o_orderstatus, (SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 FROM orders) AS mid FROM orders)
SELECT o_orderkey::VARCHAR AS key, o_orderstatus AS marker, CASE WHEN o_orderdate <= mid THEN 1 ELSE 2 END::BIGINT AS pass, 1::BIGINT AS reads FROM o""")
def watermarked_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read once each over two passes in chunks, the first of which is interrupted and taken up again."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("marker"), F.col("o_orderdate").cast("timestamp").alias("modified"), F.lit(1).alias("size"))
    low, high, total = orders.agg(F.min("modified"), F.max("modified"), F.count("*")).first()
    path = shared.new_path(spark, "passes")
    if not total:
        return spark.createDataFrame([], "key string, marker string, pass long, reads long")
    for now in (low + (high - low) / 2, high):
        listing = orders.where(F.col("modified") <= F.lit(now))
        passes = late.Passes(spark, path, skew="30 DAYS")
        passes.commit(passes.chunk(listing, F.lit(now), "size", total // 3 + 1, 1 << 40))
        # interrupted here: what goes on is made anew from what is stored
        passes = late.Passes(spark, path, skew="30 DAYS")
        while (chunk := passes.chunk(listing, F.lit(now), "size", total // 3 + 1, 1 << 40)) is not None:
            passes.commit(chunk)
        passes.complete()
    return passes.reads.all().groupBy("key", "marker").agg(F.max("pass").alias("pass"), F.count("*").alias("reads"))


@query(ORACLE["conversation_values"])
def streamed_conversation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the same conversations, whose turns come in four micro-batches: every value that goes on in a later one is held."""
    turns = shared.written(queries_values._turns(spark, sf_dir), "turns")
    path, files = shared.new_path(spark, "talk"), max(1, min(spark.sparkContext.defaultParallelism, turns.count() // TURNS_A_FILE))
    for k in range(4):  # a batch with fewer files than others may take some of the next one's, which come after all the same
        turns.where(F.col("turn") == k).repartition(files).write.mode("append").parquet(path)
    stream = conversations.Conversations(spark, shared.new_path(spark, "talks"), queries_values.YEAR)
    stream.start(_stream(spark, path, turns, files), shared.new_path(spark, "talks-state")).awaitTermination()
    stream.finish()
    return stream.findings().select("conv_id", "turn", F.col("orig_start").alias("start"), "end_turn", F.col("orig_end").alias("end"), "cls", "via", "confidence", F.size("parts").alias("parts"))
