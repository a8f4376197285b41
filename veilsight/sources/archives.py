"""Archives and compressed files as rows, one an entry, with limits against bombs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RATIO, RATIO_FROM, MAX_INFLATED = 200, 1 << 20, 100 << 20


def entries_of(content: bytes, max_entries: int | None, max_inflated: int) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(path, index, content, skipped) of a zip, tar, gzip, bzip2 or xz file, one after the other; unknown files have none."""
    import bz2
    import gzip
    import io
    import lzma
    import tarfile
    import zipfile

    def inflate(stream) -> tuple[bytes | None, str | None]:
        raw = stream.read(max_inflated + 1)
        if len(raw) > max_inflated or (len(raw) > RATIO_FROM and len(raw) > MAX_RATIO * max(1, len(content))):
            return None, "bomb"
        return raw, None

    most, read = float("inf") if max_entries is None else max_entries, 0
    try:
        if content[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
                    if i >= most:
                        yield info.filename, i, None, "entries"
                        return
                    if info.flag_bits & 1:
                        yield info.filename, i, None, "encrypted"
                    else:
                        with z.open(info) as f:
                            raw = inflate(f)
                        yield info.filename, i, *raw
                    read = i + 1
            return
        for mark, opener in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open), (b"\x28\xb5\x2f\xfd", _zstd)):
            if content.startswith(mark):
                raw, skipped = inflate(opener(io.BytesIO(content)))
                if raw and raw[257:262] == b"ustar":
                    for entry in entries_of(raw, max_entries, max_inflated):
                        read += 1
                        yield entry
                if not read:
                    yield "", 0, raw, skipped
                return
        if content[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                while (m := t.next()) is not None:
                    t.members = []  # else it keeps all of them
                    if not m.isreg():
                        continue
                    if read >= most:
                        yield m.name, read, None, "entries"
                        return
                    yield m.name, read, *inflate(t.extractfile(m))
                    read += 1
    except ImportError:
        yield "", read, None, "no_reader"
    except (OSError, EOFError, ValueError, RuntimeError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, NotImplementedError):
        yield "", read, None, "unreadable"


def _zstd(stream):
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(stream)


_MARKS = (b"PK\x03\x04", b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")


def deep_entries(content: bytes, max_entries: int | None, max_inflated: int, depth: int, path: str = "", place: str = "") -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """(path, place, content, skipped) of an archive's entries and, down to ``depth``, of the archives among these.

    Paths are joined by `` > ``, places (numbers from 0) by ``/``."""
    for name, at, raw, skipped in entries_of(content, max_entries, max_inflated):
        inner, where = " > ".join(p for p in (path, name) if p), f"{place}/{at}" if place else str(at)
        packed = raw is not None and (raw.startswith(_MARKS) or raw[257:262] == b"ustar")
        if packed and depth > 1:
            yield from deep_entries(raw, max_entries, max_inflated, depth - 1, inner, where)
        else:
            yield inner, where, raw, "depth" if packed and not skipped else skipped


def entries(files: DataFrame, max_entries: int | None = None, max_inflated: int = MAX_INFLATED, depth: int = 1) -> DataFrame:
    """path, entry, place, entry_index (the outermost place), content and skipped of the archives among binary files (path, content).

    Archives inside archives are opened down to ``depth``; what is packed deeper is given as it is and marked ``depth``
    (at a depth of 1 that isn't said).  All entries are given, one at a time, unless ``max_entries`` is; what breaks off
    has the entries before the break and then one that is ``unreadable``."""

    @F.udtf(returnType="entry: string, place: string, entry_content: binary, skipped: string")
    class Open:
        def eval(self, content: bytes):
            for entry, place, raw, skipped in deep_entries(bytes(content or b""), max_entries, max_inflated, depth):
                yield entry, place, raw, None if skipped == "depth" and depth == 1 else skipped

    files.sparkSession.udtf.register("veilsight_entries", Open)
    view = "veilsight_archives"
    files.select("path", "content").createOrReplaceTempView(view)
    return files.sparkSession.sql(f"SELECT a.path, e.entry, e.place, int(substring_index(e.place, '/', 1)) AS entry_index, e.entry_content AS content, e.skipped FROM {view} a, LATERAL veilsight_entries(a.content) e")


#: Bytes of a block of a file, and about as many of entries that are given back at once.
BLOCK, GIVEN = 64 << 10, 4 << 20


class _Blocks:
    """Blocks of one file, as a stream."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.left = blocks, memoryview(b"")

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and (len(self.left) or self._more()):
            out.append(bytes(self.left[:n]))
            self.left = self.left[len(out[-1]) :]
            n -= len(out[-1])
        return b"".join(out)

    def _more(self) -> bool:
        self.left = memoryview(next(self.blocks, b""))
        return len(self.left) > 0


def streamed_entries(blocks: Iterator[bytes], max_inflated: int) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """The same of a tar that comes in blocks, of which one entry at a time is held."""
    import tarfile

    stream, read = _Blocks(blocks), 0
    head = stream.read(512)
    if head[257:262] != b"ustar":
        return
    stream.left = memoryview(head + bytes(stream.left))
    try:
        with tarfile.open(fileobj=stream, mode="r|") as t:
            while (m := t.next()) is not None:
                t.members = []  # else it keeps all of them
                if m.isreg():
                    raw = t.extractfile(m).read(max_inflated + 1)
                    yield (m.name, read, raw, None) if len(raw) <= max_inflated else (m.name, read, None, "bomb")
                    read += 1
    except (OSError, EOFError, ValueError, tarfile.TarError):
        yield "", read, None, "unreadable"


def tar_entries(blocks: DataFrame, max_inflated: int = MAX_INFLATED) -> DataFrame:
    """path, entry, entry_index, content and skipped of tar files of any size that come as blocks (path, block, content; blocks are numbered).

    One shuffle by path, sorted by block; a task holds a batch of blocks and one entry, never a file."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        schema = pa.schema([("path", pa.string()), ("entry", pa.string()), ("entry_index", pa.int32()), ("content", pa.binary()), ("skipped", pa.string())])
        rows, size = [], 0
        each = ((path.as_py(), content.as_py()) for b in batches for path, content in zip(b.column(0), b.column(1), strict=True))
        for path, group in groupby(each, key=lambda x: x[0]):
            for entry, at, content, skipped in streamed_entries((c for _, c in group if c), max_inflated):
                rows.append((path, entry, at, content, skipped))
                size += 200 + len(content or b"")
                if size >= GIVEN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    placed = blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "content")
    return placed.mapInArrow(opened, "path string, entry string, entry_index int, content binary, skipped string")
