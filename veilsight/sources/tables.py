"""Tables as text units: one row a cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T

CELL_CHARS = 4096
#: Fixed value: rows whose cells are read together.
BATCH_ROWS = 500


def cells(df: DataFrame, keys: list[str], most: int = CELL_CHARS) -> DataFrame:
    """The readable cells of a table: keys, column, text and cut.

    Floats, doubles and booleans aren't read (floats have lost digits); numbers, decimals and dates
    are as printed, timestamps in ISO form, nested values as JSON.  Texts end after ``most`` characters; ``cut`` says of
    which cells that is true, to be counted as read in part."""
    parts = []
    for f in df.schema:
        if f.name in keys or isinstance(f.dataType, t.FloatType | t.DoubleType | t.BooleanType | t.BinaryType):
            continue
        if isinstance(f.dataType, t.TimestampType | t.TimestampNTZType):
            text = F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, t.StructType | t.ArrayType | t.MapType):
            text = F.to_json(f.name)
        else:
            text = F.col(f.name).cast("string")
        parts.append(F.struct(F.lit(f.name).alias("column"), F.left(text, F.lit(most)).alias("text"), (F.length(text) > most).alias("cut")))
    return df.select(*keys, F.explode(F.array(*parts)).alias("_c")).select(*keys, "_c.column", "_c.text", "_c.cut").where(F.col("text").isNotNull())


def chunks(cells: DataFrame, group: Sequence[str], row: str, batch: int = BATCH_ROWS, before: int = 0) -> DataFrame:
    """Text units of cells (``group``, ``row``, column, text): the cells of a column that have a digit or a number word, a line each,
    for every ``batch`` rows, so that cells next to a value are words around it.  ``before``: lines in front of row 0 that count.

    Columns: group, column, block, text, and ``cells``, the place, row and length of each cell for ``in_cells``.  A block has at most
    ``batch`` rows times the cells' greatest length; repeated rows have a line each."""
    by = [*group, "column", "block"]
    kept = cells.where(T.has_candidate(F.col("text"))).select(*group, "column", F.floor((F.col(row) + before) / batch).alias("block"), F.col(row).alias("row"), "text", F.length("text").alias("length"))
    order = Window.partitionBy(*by).orderBy("row", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept.withColumn("at", (F.sum(F.col("length") + 1).over(order) - F.col("length") - 1).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("at", "row", "length", "text")))  # of one block
    units = placed.groupBy(*by).agg(lines.alias("_lines"))
    return units.select(*by, F.array_join(F.transform("_lines", lambda c: c["text"]), "\n").alias("text"), F.transform("_lines", lambda c: F.struct(c["at"], c["row"], c["length"])).alias("cells"))


def in_cells(found: DataFrame, row: str) -> DataFrame:
    """Detections in ``chunks`` with their ``row`` and their places within the cell; one that reaches over two cells is none."""
    # the last cell that begins at or before the detection: its number is put together from powers of two
    begins = lambda k: F.get("cells", k)["at"] <= F.col("start")
    steps = F.reverse(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size("cells") + F.lit(1))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int")))
    number = F.aggregate(steps, F.lit(0), lambda at, step: F.when(begins(at + step), at + step).otherwise(at))
    rows = found.withColumn("_cell", F.get("cells", number)).where(F.col("end") <= F.col("_cell.at") + F.col("_cell.length"))
    return rows.withColumn("start", F.col("start") - F.col("_cell.at")).withColumn("end", F.col("end") - F.col("_cell.at")).withColumn(row, F.col("_cell.row")).drop("_cell", "cells")
