"""Log events as a stream: detection as they come, counts by event time, and findings kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect

#: How late an event may come, and the length of a pass over event time.
LATE, PASS = "2 minutes", "24 hours"


def parts(message: Column) -> Column:
    """A log line's parts (form, text): the JSON that it is or ends in and what is before it, else the line."""
    at = F.instr(message, "{")
    tail = message.substr(at, F.length(message))
    part = lambda form, text: F.struct(F.lit(form).alias("form"), text.alias("text"))
    ends = (at > 0) & F.try_parse_json(tail).isNotNull()
    return F.when(F.try_parse_json(message).isNotNull() | (ends & (at == 1)), F.array(part("json", message))).when(ends, F.array(part("head", message.substr(F.lit(1), at - 1)), part("json", tail))).otherwise(F.array(part("line", message)))


def found(events: DataFrame, text: str = "message", **how) -> DataFrame:
    """Detections of a stream (or table) of events, by the event's columns and the part (``form``) they are in."""
    each = events.withColumn("_part", F.explode(parts(F.col(text)))).withColumn("form", F.col("_part.form")).withColumn(text, F.col("_part.text")).drop("_part")
    return detect(each, text=text, **how)


def counts(events: DataFrame, by: list[str], text: str = "message", ts: str = "ts", late: str = LATE, length: str = PASS, **how) -> DataFrame:
    """Occurrences by group, class and tumbling window; events later than ``late`` are left out
    once their window is closed."""
    rows = found(events.withWatermark(ts, late), text, **how).where(F.col("status") == "finding")
    return rows.groupBy(F.window(ts, length).alias("window"), *by, "cls").agg(F.count(F.lit(1)).alias("occurrences"))


def apply_changes(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """A table after a batch of changes: the last change of each key wins; deleted rows go.

    ``changes`` has the table's columns, ``order`` and a boolean ``deleted``."""
    columns = current.columns
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*columns, "deleted"), F.col(order)).alias("_r")).select("_r.*")
    return current.join(last.select(*key), key, "left_anti").unionByName(last.where(~F.col("deleted")).select(*columns))
