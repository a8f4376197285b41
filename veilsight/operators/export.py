"""Sinks: findings as CSV, and as parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from .findings import severity_rank
from .incremental import running_total

#: Columns of the findings table, in order.
CSV_COLUMNS = ("finding_id", "data_type", "severity", "count", "occurrences", "confidence", "store_kind", "store", "location", "region", "first_seen", "last_seen", "at_rest_encryption", "source", "console_link")


def cell(value: Column) -> Column:
    """A cell with long digit runs masked, that no spreadsheet reads as a formula."""
    text = F.coalesce(T.redact(value.cast("string")), F.lit(""))
    return F.when(text.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(findings: DataFrame) -> DataFrame:
    """Findings as text columns, ranked by severity, count and id; ids and https links stay as they are."""
    link = F.when(F.col("console_link").rlike("^https://[A-Za-z0-9.-]+/[!-~]*$") & ~F.col("console_link").rlike('["<]'), F.col("console_link")).otherwise("")
    kept = {"count": F.col("count"), "occurrences": F.col("occurrences"), "console_link": link}
    kept["finding_id"] = F.when(F.col("finding_id").rlike("^[0-9a-f]{32}$"), F.col("finding_id")).otherwise(cell(F.col("finding_id")))
    ranked = findings.orderBy(severity_rank(F.col("severity")).desc(), F.col("count").desc(), F.col("finding_id"))
    return ranked.select(*[kept.get(c, cell(F.col(c))).alias(c) for c in CSV_COLUMNS])


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.option("header", True).mode("overwrite").csv(path)


#: Rows that one task walks through where parts are cut.
BLOCK = 1 << 16


def parts(rows: DataFrame, order: str, size: str, limit: int = 200_000, fixed: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds ``part`` (from 0): rows in order fill a part, which begins with ``fixed`` of its room taken, until the next row would take
    it over ``limit``; a row larger than that has a part of its own.  ``order`` is unique; null and negative sizes count as 0.

    Where a part ends depends on where the one before did.  So each row first gets the start of the part that would follow one begun at it
    (a range search among running sums).  Blocks of rows then shorten these chains to one hop out of the block, for the few rows at which a chain can come
    in; hops of 1, 2, 4, ... blocks are joined with themselves until the first row's chain is whole; and each block
    marks the starts behind its one way in.  No task has more than ``block`` rows of a chain, or a range of the rows."""
    room = limit - fixed
    sized = rows.select(order, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_n"), F.lit(1).alias("_one"))
    placed = running_total(sized, order, ["_n", "_one"])
    placed = shared.written(placed.select(order, (F.col("total__one") - 1).alias("pos"), (F.col("total__n") - F.col("_n")).alias("begin"), F.col("total__n").alias("end")), "placed")
    # how many rows end within a part that begins here: ends and such limits in one order, ends first
    ends = placed.select(F.struct(F.col("end").alias("at"), F.lit(0).alias("kind"), "pos").alias("o"), F.lit(1).alias("fits"))
    asks = placed.select(F.struct((F.col("begin") + room).alias("at"), F.lit(1).alias("kind"), "pos").alias("o"), F.lit(0).alias("fits"))
    found = running_total(ends.unionAll(asks), "o", ["fits"]).where("o.kind = 1")
    nexts = shared.written(found.select(F.col("o.pos").alias("pos"), F.greatest(F.col("o.pos") + 1, F.col("total_fits")).alias("next"), F.floor(F.col("o.pos") / block).cast("long").alias("block")), "nexts")

    def leave(table: pa.Table) -> pa.Table:
        pos, hop = _walkable(table)
        inside = hop < pos[0] + len(pos)
        while inside.any():  # doubles the hops that stay in the block
            hop[inside] = hop[hop[inside] - pos[0]]
            inside = hop < pos[0] + len(pos)
        return pa.table({"pos": pos, "hop": hop})

    hops = shared.written(nexts.groupBy("block").applyInArrow(leave, "pos long, hop long"), "hops")
    doors = hops.select(F.col("hop").alias("pos")).unionAll(hops.sparkSession.range(1).select(F.col("id").alias("pos"))).distinct()
    hops = shared.written(hops.join(doors, "pos", "left_semi"), "doors")
    blocks, last = nexts.agg(F.max("block"), F.max("pos")).first()
    reached = hops.where("pos = 0").select("pos")
    for _ in range(((blocks or 0) + 1).bit_length()):
        more = reached.join(hops, "pos").select(F.col("hop").alias("pos")).where(F.col("pos") <= F.lit(last))
        reached = shared.written(reached.unionAll(more), "reached")
        twice = hops.join(hops.select(F.col("pos").alias("hop"), F.col("hop").alias("far")), "hop")
        hops = shared.written(twice.select("pos", F.col("far").alias("hop")), "doors")
    entry = reached.select(F.col("pos").alias("entry"), F.floor(F.col("pos") / block).cast("long").alias("block"))

    def mark(table: pa.Table) -> pa.Table:
        pos, hop = _walkable(table)
        starts = np.zeros(len(pos), np.int32)
        way_in = table.column("entry")[0].as_py()
        at = len(pos) if way_in is None else way_in - pos[0]
        while at < len(pos):
            starts[at] = 1
            at = hop[at] - pos[0]
        return pa.table({"pos": pos, "starts": starts})

    marked = nexts.join(entry, "block", "left").groupBy("block").applyInArrow(mark, "pos long, starts int")
    told = running_total(marked, "pos", ["starts"]).select("pos", (F.col("total_starts") - 1).alias("part"))
    return rows.join(placed.select(order, "pos").join(told, "pos").drop("pos"), order)


def _walkable(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's places in order, and the next start of each."""
    pos, hop = (table.column(c).to_numpy() for c in ("pos", "next"))
    by = np.argsort(pos)
    return pos[by], hop[by]


def document(ranked: DataFrame, head: dict[str, str]) -> DataFrame:
    """One row, ``document``: the findings document as JSON, of findings that ``findings.top`` has cut to its fixed number."""
    rows = ranked.withColumn("_at", F.monotonically_increasing_id())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*ranked.columns).alias("f")))), lambda x: x["f"])
    made = rows.agg(listed.alias("findings"))
    return made.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in head.items()], "findings")).alias("document"))


def escaped(value: Column) -> Column:
    """A value as HTML text, with long digit runs masked; null is empty."""
    text = F.coalesce(T.redact(value.cast("string")), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def html(title: str, sections: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """A report as lines of HTML (section, place, line) in order of section and place.

    sections: (heading, rows, columns to sort by); each becomes a table of all its rows.  Lines stay rows
    of a DataFrame, so a report of any length is written by Spark; ``write_html`` makes it one file."""
    first = sections[0][1].sparkSession
    says = lambda k, at, text: first.createDataFrame([(k, at, text)], "section int, place long, line string")
    plain = lambda text: text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = [says(-1, 0, f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{plain(title)}</title><h1>{plain(title)}</h1>')]
    for k, (heading, rows, order) in enumerate(sections):
        head = "".join(f"<th>{plain(c)}</th>" for c in rows.columns)
        out.append(says(k, -1, f"<h2>{plain(heading)}</h2><table><tr>{head}</tr>"))
        cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(f"`{c}`")), F.lit("</td>")) for c in rows.columns], F.lit("</tr>"))
        # after a range sort, ids rise with the partitions and within them
        out.append(rows.orderBy(*order).select(F.lit(k).alias("section"), F.monotonically_increasing_id().alias("place"), cells.alias("line")))
        out.append(says(k, (1 << 63) - 1, "</table>"))
    out.append(says(len(sections), 0, "</html>"))
    return reduce(DataFrame.unionByName, out).orderBy("section", "place")


def write_html(title: str, sections: Sequence[tuple[str, DataFrame, Sequence[str]]], path: str) -> None:
    html(title, sections).select("line").coalesce(1).write.mode("overwrite").text(path)
