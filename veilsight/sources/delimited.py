"""CSV, TSV and JSON Lines texts as text units with their places.

Edge cases: null and empty texts have no units; a last line without an end counts; rows may differ in length, and
cells behind the header's end have no name; lines that aren't JSON give no leaves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .json_leaves import leaves

CELLS = "array<struct<row:int,at:int,start:int,end:int,text:string>>"


def split_cells(text: str, mark: str) -> Iterator[tuple[int, int, int, int]]:
    """(row, column, start, end) of every cell's content.  Quotes around a cell aren't content, doubled ones inside stay
    doubled; a row ends at a line feed outside quotes, and a carriage return before it goes with it."""
    row = at = i = 0
    n = len(text)
    while True:
        if text[i : i + 1] == '"':
            start = i + 1
            end = text.find('"', start)
            while end >= 0 and text[end + 1 : end + 2] == '"':
                end = text.find('"', end + 2)
            end = n if end < 0 else end
            stop = min(end + 1, n)
        else:
            start = end = stop = i
        ends = [p for p in (text.find(mark, stop), text.find("\n", stop)) if p >= 0]
        stop = min(ends, default=n)
        if start == i:
            end = stop - (text[start:stop].endswith("\r"))
        yield row, at, start, end
        if stop >= n:
            return
        row, at = (row, at + 1) if text[stop] == mark else (row + 1, 0)
        i = stop + 1


def cells(texts: DataFrame, keys: list[str], text: str = "text", delimiter: Column | str = ",", names: Sequence[str] | None = None) -> DataFrame:
    """keys, row (1 is the first behind the header), at, column (the header's name), start, end (code points of the text) and
    text of each cell that isn't empty; the header's own cells are row 0.

    With ``names``, the columns that a catalog has of texts without a header, row 0 is the first row."""
    mark = F.lit(delimiter) if isinstance(delimiter, str) else delimiter

    @F.arrow_udf(CELLS)
    def read(parts: pa.Array, marks: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("row", pa.int32()), ("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        return pa.array([[{"row": r, "at": c, "start": a, "end": b, "text": t[a:b]} for r, c, a, b in split_cells(t, m)] if t else [] for t, m in zip(parts.to_pylist(), marks.to_pylist(), strict=True)], kind)

    rows = texts.select(*keys, read(F.col(text), mark).alias("_c"))
    header = F.transform(F.filter("_c", lambda c: c["row"] == 0), lambda c: c["text"])
    rows = rows.withColumn("_names", header if names is None else F.array(*[F.lit(n) for n in names])).select(*keys, "_names", F.inline("_c").alias("row", "at", "start", "end", "text"))
    return rows.select(*keys, "row", "at", F.get("_names", F.col("at")).alias("column"), "start", "end", "text").where(F.col("end") > F.col("start"))


def lines(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pointer (``/<line>/...``), name and text of each scalar of JSON Lines."""
    rows = texts.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_line", "_doc"))
    found = leaves(rows, [*keys, "_line"], "_doc")
    return found.select(*keys, F.concat(F.lit("/"), F.col("_line").cast("string"), "pointer").alias("pointer"), "name", "text")


def is_json_lines(path: Column, text: Column) -> Column:
    """Whether a file is JSON Lines: by its name, or by two objects on lines of their own."""
    return F.coalesce(F.lower(path).rlike(r"\.(?:jsonl|ndjson)$") | text.rlike(r"(?s)^\s*\{.*\}\s*\n\s*\{"), F.lit(False))


def units(texts: DataFrame, keys: list[str], **how) -> DataFrame:
    """Cells that could hold a value, with the column's own name as their context."""
    return cells(texts, keys, **how).where("row > 0").where(T.has_candidate(F.col("text")))
