"""Whole passes: units to findings, with coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import findings as f
from ..operators.detect import detect
from ..sources import json_leaves, tables


def documents(docs: DataFrame, key: str, text: str = "text", resource: dict[str, Column] | None = None, **how) -> DataFrame:
    """One finding a document and class: key, cls, counts, confidence, via, severity and id."""
    found = f.summarize(detect(docs.select(key, text), text=text, **how), [key])
    return found.withColumn("id", f.finding_id(resource or {key: F.col(key)}, F.col("cls")))


def table(df: DataFrame, keys: list[str], **how) -> DataFrame:
    """One finding a column and class of a table; the column's name is context."""
    units = tables.cells(df, keys).where(T.has_candidate(F.col("text")))
    return f.summarize(detect(units, context=F.col("column"), name="column", **how), ["column"])


def table_places(df: DataFrame, group: list[str], row: str, batch: int = tables.BATCH_ROWS, **how) -> DataFrame:
    """One detection a value of a table whose rows are numbered, with the cell's pointer; the column's name and the cells
    next to it in its column are context.

    One scan and one shuffle, by ``group``, column and block of ``batch`` rows."""
    units = tables.chunks(tables.cells(df, [*group, row]), group, row, batch)
    found = tables.in_cells(detect(units, context=F.col("column"), name="column", **how), row)
    return found.withColumn("pointer", F.concat(F.lit("/"), F.col(row).cast("string"), F.lit("/"), T.pointer_escape(F.col("column")))).drop("block")


def table_coverage(df: DataFrame, keys: list[str], most: int = tables.CELL_CHARS) -> DataFrame:
    """What a pass over a table's cells reads, by column: cells, candidates, cells that are cut and characters read."""
    cells = tables.cells(df, keys, most)
    return cells.groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.count_if(T.has_candidate(F.col("text"))).alias("candidates"), F.count_if("cut").alias("cut"), F.sum(F.length("text")).alias("chars"))


def json_coverage(df: DataFrame, keys: list[str], column: str, **limits) -> DataFrame:
    """What a pass over JSON documents reads: scalars, and those beyond the limits, which are left out."""
    read = json_leaves.opened(df, keys, column, **limits)
    return read.select(*keys, F.size("json.leaves").alias("leaves"), F.col("json.left_out").alias("left_out"))


def json_documents(df: DataFrame, key: str, column: str, **how) -> DataFrame:
    """One finding a JSON pointer and class; key names are context."""
    units = json_leaves.leaves(df, [key], column).where(T.has_candidate(F.col("text")))
    return f.summarize(detect(units, context=F.col("name"), name="name", **how), [key, "pointer"])


def coverage(docs: DataFrame, group: list[str], text: str = "text") -> DataFrame:
    """Items, items with something to look at, and characters by group."""
    return docs.groupBy(*group).agg(F.count(F.lit(1)).alias("items"), F.count_if(T.has_candidate(F.col(text))).alias("candidates"), F.sum(F.length(text)).alias("chars"))
