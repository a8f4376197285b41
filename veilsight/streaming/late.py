"""Late events counted beside the result, and passes whose watermark moves only when they are complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import admit
from .versions import Versions


class LateSplit:
    """Splits micro-batches at the watermark: the greatest event time of the batches before, less ``delay``.

    Spark drops what is behind its watermark and tells a number; here each such event stays in a table of its own.  Both
    tables and the watermark have a version a batch, so a batch that is run again changes nothing.  Events without
    a time are late."""

    def __init__(self, spark, path: str, schema: StructType, ts: str = "ts", delay: str = "2 minutes"):
        self.ts, self.delay = ts, delay
        self.kept, self.late = (Versions(spark, f"{path}/{name}", schema) for name in ("kept", "late"))
        self.mark = Versions(spark, f"{path}/mark", "seen timestamp")

    def apply(self, batch: DataFrame, number: int) -> None:
        row = self.mark.read(number).first()
        seen = row["seen"] if row else None
        rows = batch.select(*self.kept.schema.names)
        behind = F.col(self.ts).isNull() | (F.lit(False) if seen is None else F.col(self.ts).cast("timestamp") < F.lit(seen) - F.expr(f"INTERVAL {self.delay}"))
        self.kept.write(rows.where(~behind), number)
        self.late.write(rows.where(behind), number)
        latest = rows.agg(F.greatest(F.max(F.col(self.ts).cast("timestamp")), F.lit(seen).cast("timestamp")).alias("seen"))
        self.mark.write(latest.coalesce(1), number)

    def start(self, events: DataFrame, checkpoint: str):
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Passes:
    """Passes over a store that is listed (key, marker, modified): what is new since the last complete pass, in chunks.

    The watermark is the time at which the last complete pass began; a pass lists from ``skew`` before it, as listings lag.
    What a chunk has read is committed with the chunk, so a pass that is interrupted goes on behind its last chunk: nothing is
    lost, as the watermark hasn't moved, and nothing is read twice, as items read under the same marker are left out."""

    def __init__(self, spark, path: str, skew: str = "15 minutes"):
        self.skew = skew
        self.state = Versions(spark, f"{path}/state", "watermark timestamp, began timestamp, pass long")
        self.reads = Versions(spark, f"{path}/reads", "key string, marker string, modified timestamp, pass long")

    def chunk(self, listing: DataFrame, now: Column, size: str, max_items: int, max_bytes: int) -> DataFrame | None:
        """The next items to read, by key, within a budget; None if the pass is over, which ``complete`` then records."""
        step = self.state.last()
        at = self.state.read().first() if step is not None else None
        if at is None or at["began"] is None:
            began = listing.sparkSession.range(1).select(F.lit(at["watermark"] if at else None).cast("timestamp").alias("watermark"), now.cast("timestamp").alias("began"), F.lit((at["pass"] if at else 0) + 1).cast("long").alias("pass"))
            self.state.write(began.coalesce(1), 0 if step is None else step + 1)
            at = self.state.read().first()
        open_ = listing.where(F.col("modified") <= F.lit(at["began"]))
        if at["watermark"] is not None:
            open_ = open_.where(F.col("modified") >= F.lit(at["watermark"]) - F.expr(f"INTERVAL {self.skew}"))
        known = self.reads.all().select(F.col("key").alias("_k"), F.col("marker").alias("_m"))
        left = open_.join(known, (F.col("key") == F.col("_k")) & F.col("marker").eqNullSafe(F.col("_m")), "left_anti")
        if left.isEmpty():
            return None
        return admit(left, "key", size, max_items, max_bytes)

    def commit(self, chunk: DataFrame) -> None:
        """After the chunk's results are written: its items are read."""
        number = self.reads.last()
        rows = chunk.select(F.col("key").cast("string").alias("key"), F.col("marker").cast("string").alias("marker"), F.col("modified").cast("timestamp").alias("modified"), F.lit(self.state.read().first()["pass"]).cast("long").alias("pass"))
        self.reads.write(rows, 0 if number is None else number + 1)

    def complete(self) -> None:
        """The pass has read all: its beginning is the next watermark."""
        rows = self.state.read().select(F.coalesce("began", "watermark").alias("watermark"), F.lit(None).cast("timestamp").alias("began"), "pass")
        self.state.write(rows.coalesce(1), self.state.last() + 1)
