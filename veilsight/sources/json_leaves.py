"""JSON documents as text units: one row a scalar, with its pointer.

One pass: each document is opened where it is, so no step waits for the deepest one.

Edge cases: null texts and those that aren't JSON have no leaves; nulls and booleans aren't read; what lies below
``MAX_DEPTH`` levels or behind ``MAX_LEAVES`` scalars of a document isn't either, and ``left_out`` says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import each_slice

MAX_DEPTH, MAX_LEAVES = 32, 20_000
_LEAF = "struct<leaves:array<struct<pointer:string,name:string,text:string>>,left_out:int>"


def _scalars(value: object, pointer: str, name: str | None, depth: int) -> Iterator[tuple[str, str | None, str | None]]:
    """Pointer, name and text of each scalar; a text of None where it is too deep."""
    if isinstance(value, dict):
        inner = [(k, v, k) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [(str(i), v, name) for i, v in enumerate(value)]
    else:
        if value is not None and not isinstance(value, bool):
            yield pointer, name, value if isinstance(value, str) else json.dumps(value)
        return
    if depth == 0:
        yield pointer, name, None
        return
    for key, v, called in inner:
        yield from _scalars(v, pointer + "/" + key.replace("~", "~0").replace("/", "~1"), called, depth - 1)


def opened(df: DataFrame, keys: list[str], column: str, max_depth: int = MAX_DEPTH, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """keys and ``json``: a document's leaves, and how many were left out."""

    @F.arrow_udf(_LEAF)
    def read(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("leaves", pa.list_(pa.struct([(c, pa.string()) for c in ("pointer", "name", "text")]))), ("left_out", pa.int32())])

        def one(doc: str | None) -> dict:
            try:
                found = list(_scalars(json.loads(doc), "", None, max_depth)) if doc else []
            except (ValueError, RecursionError):
                found = []
            good = [f for f in found if f[2] is not None]
            return {"leaves": [{"pointer": p, "name": n, "text": t} for p, n, t in good[:max_leaves]], "left_out": len(found) - len(good) + max(0, len(good) - max_leaves)}

        for part in parts:
            yield from each_slice(part, lambda docs: [one(d) for d in docs], kind)

    return df.select(*keys, read(F.col(column)).alias("json"))


def leaves(df: DataFrame, keys: list[str], column: str, max_depth: int = MAX_DEPTH, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """keys, pointer (RFC 6901), name (the last key that is no list index) and text of each scalar."""
    return opened(df, keys, column, max_depth, max_leaves).select(*keys, F.inline("json.leaves"))
