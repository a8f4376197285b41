"""Places of matches in texts, as Arrow functions: what column expressions can't tell in linear time.

Only finding, cutting and masking is done here; what a match is worth is decided in column expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import spec

FOUND = "array<struct<family:int,raw:string,start:int,end:int,left:string,right:string>>"
_RUN = re.compile("[0-9]+")
#: Rows and bytes of a batch that are Python objects at once.
ROWS, BYTES = 512, 4 << 20


def slices(part: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of bounded rows and bytes (a larger row is a slice of its own), so that what Python makes of them is bounded too."""
    at, mean = 0, max(1, part.nbytes // max(1, len(part)))
    rows = max(1, min(ROWS, BYTES // mean))
    while at < len(part) or at == 0:
        n = rows
        while n > 1 and part.slice(at, n).nbytes > 2 * BYTES:
            n = n // 2
        yield part.slice(at, n)
        at += n


def each_slice(part: pa.Array, made: Callable[[list], list], kind: pa.DataType) -> Iterator[pa.Array]:
    """What ``made`` makes of a batch's values, worked out and given back slice by slice: it may be many times as large as the batch."""
    for some in slices(part):
        yield pa.array(made(some.to_pylist()), kind)


def by_slices(part: pa.Array, made: Callable[[list], list], kind: pa.DataType) -> pa.Array:
    """The same as one array."""
    return pa.concat_arrays(list(each_slice(part, made, kind)))


def hits(text: str, patterns: Sequence[re.Pattern], digit_first: Sequence[bool]) -> list[tuple[int, int, int]]:
    """(start, end, pattern) of all matches by start.  A pattern of ``digit_first`` matches at the beginning of a run of digits only,
    so it is tried there and nowhere else."""
    runs = [m.start() for m in _RUN.finditer(text)] if any(digit_first) else []
    out, months = [], None
    for k, p in enumerate(patterns):
        if p.pattern == spec.DATES_WRITTEN[2]:  # most texts name no month, which is told faster
            if months is None:
                folded = text.casefold()
                months = any(m[:3] in folded for m in spec.MONTHS)
            if not months:
                continue
        if not digit_first[k]:
            out += [(m.start(), m.end(), k) for m in p.finditer(text)]
            continue
        upto = 0
        for a in runs:
            if a >= upto and (m := p.match(text, a)):
                upto = m.end()
                out.append((a, upto, k))
    return sorted(out)


def found_kind() -> pa.DataType:
    """``FOUND`` as Arrow has it."""
    return pa.list_(pa.struct([("family", pa.int32()), ("raw", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("right", pa.string())]))


def matches(t: str | None, patterns: Sequence[re.Pattern], digit_first: Sequence[bool], before: int, after: int) -> list[dict]:
    return [{"family": k, "raw": t[a:b], "start": a, "end": b, "left": t[max(0, a - before) : a], "right": t[b : b + after]} for a, b, k in hits(t, patterns, digit_first)] if t else []


def find(text: Column, patterns: Sequence[str], before: int, after: int) -> Column:
    """Every match of each pattern (Python's syntax) by start: the pattern's number, the match, its place in code points,
    and up to so many characters on its left and right.  Null texts have none.

    Patterns of ``spec.DIGIT_FIRST`` are looked for at runs of digits alone."""

    @F.arrow_udf(FOUND)
    def places(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made, first = [re.compile(p) for p in patterns], [p in spec.DIGIT_FIRST for p in patterns]
        def found(texts: list) -> list:
            return [matches(t, made, first, before, after) for t in texts]

        for part in parts:
            yield from each_slice(part, found, found_kind())

    return places(text)


def cut(text: str, size: int, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Stretches of at most ``size`` characters that end behind a line's end where there is one."""
    out, at, end = [], start, len(text) if end is None else end
    while end - at > size:
        line = text.rfind("\n", at + 1, at + size)
        out.append((at, line + 1 if line >= 0 else at + size))
        at = out[-1][1]
    return [*out, (at, end)] if at < end else out


def pieces(text: Column, size: int, before: int, after: int) -> Column:
    """A text in stretches as ``cut`` makes them, each with so many characters around: (low, start, end, piece), where piece begins at low.

    Meant for texts far longer than others: it goes over each stretch many times, but not through Python, where the rows of all others would wait beside it."""
    # the rest, or up to the last line's end, or all of a size
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}\z|.{{1,{max(1, size - 1)}}}\n|.{{1,{size}}}"), 0)
    sized = F.transform(F.array(F.struct(parts.alias("p"), F.transform(parts, lambda p: F.length(p)).alias("n"))), lambda s: F.transform(s["p"], lambda p, i: _piece(s["p"], s["n"], p, i, size, before, after)))
    whole = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("piece")))
    return F.when(F.length(text) > size, F.flatten(sized)).otherwise(whole)


def _piece(parts: Column, lengths: Column, part: Column, i: Column, size: int, before: int, after: int) -> Column:
    """The stretch at ``i`` with what is around.  Two in a row are together as long as a full one."""
    near = lambda k: F.coalesce(F.get(parts, i + k), F.lit(""))
    reach = 2 * -(-max(before, after, 1) // size)
    left, right = F.concat(*[near(k) for k in range(-reach, 0)]), F.concat(*[near(k) for k in range(1, reach + 1)])
    left, start = F.substring(left, F.greatest(F.length(left) - before, F.lit(0)) + 1, F.lit(before)), F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda n, x: n + x)
    return F.struct((start - F.length(left)).alias("low"), start.alias("start"), (start + F.get(lengths, i)).alias("end"), F.concat(left, part, F.substring(right, 1, after)).alias("piece"))


def mask(text: Column, places: Column, sign: str = "#") -> Column:
    """A text with the characters of some places, array<struct<start:int,end:int>> in code points, masked."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spots: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts.to_pylist(), spots.to_pylist(), strict=True):
            if t is not None:
                chars = list(t)
                for s in spans or ():
                    chars[s["start"] : s["end"]] = sign * len(chars[s["start"] : s["end"]])
                t = "".join(chars)
            out.append(t)
        return pa.array(out, pa.string())

    return masked(text, places)


def utf16(text: str) -> list[int]:
    """Code points above the basic plane in a text, for ``shift``."""
    return [] if text.isascii() else [m.start() for m in re.finditer("[\U00010000-\U0010ffff]", text)]


def shift(at: int, high: list[int]) -> int:
    """A code point's place in UTF-16 units."""
    return at + bisect_right(high, at - 1)
