"""Items of key-value stores, whose values say their own type (S, N, M, L, SS, NS), as text units.

One pass over the items; each is opened where it is, so no step waits for the deepest item.

Edge cases: null items and texts that aren't JSON objects have no leaves; binary values, booleans,
nulls and values below ``max_depth`` aren't read; an empty table has no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import each_slice
from .json_leaves import MAX_DEPTH

_PATH = re.compile(r"[^.\[\]]+(?:\.[^.\[\]]+|\[[^\]]*\])*")
_TEXTS = pa.map_(pa.string(), pa.string())
_STEPS = pa.list_(pa.struct([("key", pa.string()), ("position", pa.int64()), ("fields", _TEXTS)]))
#: What is known of a leaf: its type in Spark and in Arrow, and how it is worked out of its number, steps and text.
_LEAF = {
    "ord": ("bigint", pa.int64(), lambda n, steps, text: n),
    "pointer": ("string", pa.string(), lambda n, steps, text: _pointer(steps)),
    "path": ("string", pa.string(), lambda n, steps, text: _path(steps)),
    "name": ("string", pa.string(), lambda n, steps, text: next(s[0] for s in reversed(steps) if s[0] is not None)),
    "list_id": ("string", pa.string(), lambda n, steps, text: _pointer(steps[: i]) if (i := _last_list(steps)) is not None else None),
    "position": ("bigint", pa.int64(), lambda n, steps, text: steps[i][1] if (i := _last_list(steps)) is not None else None),
    "fields": ("map<string, string>", _TEXTS, lambda n, steps, text: steps[i][2] if (i := _last_list(steps)) is not None else {}),
    "steps": ("array<struct<key: string, position: bigint, fields: map<string, string>>>", _STEPS, lambda n, steps, text: [{"key": k, "position": at, "fields": None if fields is None else list(fields.items())} for k, at, fields in steps]),
    "text": ("string", pa.string(), lambda n, steps, text: text),
}


def _last_list(steps: list[tuple]) -> int | None:
    return next((i for i in range(len(steps) - 1, -1, -1) if steps[i][0] is None), None)


def _text(value: object) -> str | None:
    """A string's or a number's text; null for any other value."""
    if isinstance(value, dict):
        for tag in ("S", "N"):
            if value.get(tag) is not None:
                return str(value[tag])
    return None


def _fields(value: object) -> dict[str, str]:
    inner = value.get("M") if isinstance(value, dict) else None
    return {k: t for k, v in inner.items() if (t := _text(v)) is not None} if isinstance(inner, dict) else {}


def _pointer(steps: list[tuple]) -> str:
    return "".join("/" + (str(at) if key is None else key.replace("~", "~0").replace("/", "~1")) for key, at, _ in steps)


def _path(steps: list[tuple]) -> str:
    return "".join("[]" if key is None else "." + key for key, _, _ in steps).lstrip(".")


def _open(value: object, steps: list[tuple], max_depth: int) -> Iterator[tuple[list[tuple], str]]:
    if len(steps) > max_depth or not isinstance(value, dict):
        return
    text = _text(value)
    if text is not None:
        yield steps, text
    elif isinstance(value.get("M"), dict):
        for key, inner in value["M"].items():
            yield from _open(inner, [*steps, (key, None, None)], max_depth)
    elif isinstance(value.get("L"), list):
        for at, inner in enumerate(value["L"]):
            yield from _open(inner, [*steps, (None, at, _fields(inner))], max_depth)
    else:
        members = value.get("SS") or value.get("NS")
        for at, inner in enumerate(members if isinstance(members, list) else []):
            yield [*steps, (None, at, {})], str(inner)


def _item(doc: str | None, max_depth: int, only: Sequence[str] = tuple(_LEAF)) -> list[dict]:
    try:
        item = json.loads(doc) if doc else None
    except (ValueError, RecursionError):
        item = None
    if not isinstance(item, dict):
        return []
    made = [(c, _LEAF[c][2]) for c in only]
    return [{c: f(n, steps, text) for c, f in made} for n, (steps, text) in enumerate(_open({"M": item}, [], max_depth))]


def leaves(df: DataFrame, keys: list[str], column: str, max_depth: int = MAX_DEPTH, only: Sequence[str] = tuple(_LEAF)) -> DataFrame:
    """keys and one row a string or number: ord (from 0 in the item), pointer, path (with [] for a
    list's elements), name, text, steps, and of the innermost list list_id (its pointer), position
    and fields (the element's own strings and numbers).  ``only``: those of these columns that are asked for."""
    kind = pa.list_(pa.struct([(c, _LEAF[c][1]) for c in only]))

    @F.arrow_udf("array<struct<" + ", ".join(f"{c}: {_LEAF[c][0]}" for c in only) + ">>")
    def opened(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield from each_slice(part, lambda docs: [[{c: list(v.items()) if isinstance(v, dict) else v for c, v in leaf.items()} for leaf in _item(d, max_depth, only)] for d in docs], kind)

    return df.select(*keys, F.explode(opened(F.col(column).cast("string"))).alias("_leaf")).select(*keys, "_leaf.*")


def covers(path: str, steps: Column) -> Column:
    """Whether a path like ``a.b``, ``a[].b`` or ``a[kind=x,n=2].b`` covers the leaf at ``steps``: each of
    its parts fits the leaf's step in the same place, and the leaf may be deeper."""
    if not _PATH.fullmatch(path.strip()):
        raise ValueError(f"no attribute path: {path!r}")
    parts = re.findall(r"\[([^\]]*)\]|([^.\[\]]+)", path.strip())
    fits = F.size(steps) >= len(parts)
    for i, (inside, name) in enumerate(parts):
        step = F.get(steps, F.lit(i))
        if name:
            fits &= step["key"].eqNullSafe(F.lit(name))
            continue
        fits &= step["position"].isNotNull()
        for condition in filter(None, inside.split(",")):
            field, equals, value = condition.partition("=")
            if not equals or not field.strip():
                raise ValueError(f"no attribute path: {path!r}")
            fits &= step["fields"][field.strip()].eqNullSafe(F.lit(value.strip()))
    return F.coalesce(fits, F.lit(False))


def ordered(order_by: str | None = None) -> Column:
    """A leaf's order in its list, for ``transcripts.answers``: the named field where it is a number,
    else the position; then the position and the place in the item."""
    named = F.col("fields")[order_by].try_cast("double") if order_by else F.lit(None).cast("double")
    return F.struct(F.coalesce(named, F.col("position").cast("double")).alias("at"), "position", "ord")
