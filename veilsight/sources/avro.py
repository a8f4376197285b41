"""Avro container files as rows of JSON, which ``json_leaves`` opens.

Edge cases: files that are no containers, or break off, give the rows before the break and then one row with ``error``; bytes, fixed
values, floats, doubles and booleans aren't read; recursive types end at ``MAX_DEPTH``; a file without rows gives none.
"""

from __future__ import annotations

import bz2
import json
import lzma
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 32
BATCH = 1000


class Bytes:
    """A place in some bytes, read from left to right."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("broken off")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value >> 1 ^ -(value & 1)
            shift += 7

    def blocks(self) -> Iterator[int]:
        """Item numbers of an array or a map."""
        while n := self.long():
            if n < 0:
                self.long()
            yield from range(abs(n))


def _value(src: Bytes, kind: object, names: dict, depth: int) -> object:
    if depth > MAX_DEPTH:
        raise ValueError("too deep")
    if isinstance(kind, list):
        return _value(src, kind[src.long()], names, depth)
    name = kind["type"] if isinstance(kind, dict) else kind
    if isinstance(name, dict | list):
        return _value(src, name, names, depth)
    if name in names and not isinstance(kind, dict):
        return _value(src, names[name], names, depth)
    match name:
        case "null":
            return None
        case "boolean":
            src.take(1)
        case "float" | "double":
            src.take(4 if name == "float" else 8)
        case "int" | "long":
            return src.long()
        case "bytes":
            src.take(src.long())
        case "fixed":
            src.take(kind["size"])
        case "string":
            return src.take(src.long()).decode("utf-8", "replace")
        case "enum":
            return kind["symbols"][src.long()]
        case "array":
            return [_value(src, kind["items"], names, depth + 1) for _ in src.blocks()]
        case "map":
            return {_value(src, "string", names, depth): _value(src, kind["values"], names, depth + 1) for _ in src.blocks()}
        case "record" | "error":
            return {f["name"]: _value(src, f["type"], names, depth + 1) for f in kind["fields"]}
        case _:
            raise ValueError("unknown type")
    return None


def _named(kind: object, names: dict, space: str = "") -> None:
    """Notes the types that have a name, so that later ones may refer to them."""
    if isinstance(kind, list):
        for k in kind:
            _named(k, names, space)
    elif isinstance(kind, dict):
        space = kind.get("namespace", space)
        if "name" in kind:
            names |= {kind["name"]: kind, f"{space}.{kind['name']}".lstrip("."): kind}
        for k in (kind.get("type"), kind.get("items"), kind.get("values"), *(f["type"] for f in kind.get("fields", ()))):
            _named(k, names, space)


def _inflate(codec: str, data: bytes, most: int) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompressobj(-15).decompress(data, most)
    if codec == "bzip2":
        return bz2.BZ2Decompressor().decompress(data, most)
    if codec == "xz":
        return lzma.LZMADecompressor().decompress(data, most)
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "snappy":  # its length comes first, as seven bits a byte; four bytes of checksum come last
        size = sum((b & 127) << 7 * i for i, b in enumerate(data[: next(i for i, b in enumerate(data) if b < 128) + 1]))
        if size > most:
            raise ValueError("too large")
        return pa.Codec("snappy").decompress(data[:-4], size).to_pybytes()
    raise ValueError("unknown codec")


def read_rows(content: bytes, most: int = 100 << 20) -> Iterator[object]:
    """The rows of a container; an error where it breaks off.  No block is inflated to over ``most`` bytes."""
    src = Bytes(content)
    if src.take(4) != b"Obj\x01":
        raise ValueError("no container")
    meta = {}
    for _ in src.blocks():
        key = src.take(src.long()).decode()
        meta[key] = src.take(src.long())
    sync = src.take(16)
    schema, names, codec = json.loads(meta["avro.schema"]), {}, meta.get("avro.codec", b"null").decode()
    _named(schema, names)
    while src.at < len(content):
        n = src.long()
        block = Bytes(_inflate(codec, src.take(src.long()), most))
        for _ in range(n):
            yield _value(block, schema, names, 0)
        if src.take(16) != sync:
            raise ValueError("broken off")


def rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, row (from 0), doc (JSON) and error of the rows of container files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held):
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key_kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["key", "row", "doc", "error"])

        for b in batches:
            key_kind = b.schema.field(0).type
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held, n = [], 0
                try:
                    for value in read_rows(raw.as_py() or b""):
                        held.append((k, n, json.dumps(value), None))
                        n += 1
                        if len(held) == BATCH:
                            yield batch(held)
                            held = []
                except (ValueError, LookupError, TypeError, OSError, zlib.error, lzma.LZMAError, pa.ArrowException, ImportError, StopIteration) as e:
                    held.append((k, n, None, str(e) or type(e).__name__))
                if held:
                    yield batch(held)

    kind = files.schema[key].dataType.simpleString()
    out = files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(read, f"key {kind}, row bigint, doc string, error string")
    return out.withColumnRenamed("key", key)
