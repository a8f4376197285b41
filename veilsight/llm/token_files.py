"""Token files: frequency-ranked ids, byte-aligned, with control bytes of their own.

Whole texts are encoded with a tokenizer file of the ``tokenizers`` library, and an end id is appended
to each.  Ids are replaced by their rank among all ids of the corpus by falling frequency, so the common
ones fit one byte.  A block holds some documents' ranks: first one control byte for each four
ranks (two bits a rank: its bytes less one), then the ranks' bytes, little-endian, without gaps.
Reading looks each control byte up in a table of its four lengths, sums them to the
places of all ranks at once, and gathers them by numpy.

A shard is a range of ids; its blocks are rows of a Parquet table that Spark writes and
reads, so token files can be wherever Spark's other files are.  The rank table (one row an id of
the vocabulary) and the shards' totals (one row a shard) are beside it.

Encoding splits a text where byte-level vocabularies without a normalizer never join (before
a single space or newline between two characters, and before punctuation after a letter), so a task encodes each distinct piece once and keeps its ids (up to about ``CACHE`` pieces, by 64-bit hash and length; those
seen once go first).
Other vocabularies get whole texts.

Edge cases: null texts are empty and have the end id alone; rows with equal ids keep an
order given by their ids' checksum; null document ids come first; an empty table makes an empty file.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .arrays import Laid, runs, utf8

END_ID = 2
CACHE = 600_000
RUN_BYTES = 1 << 20
BLOCK_IDS = 1 << 20
#: Bytes of ids from which a shard is one of more.
SHARD_BYTES = 64 << 20

_LENGTHS = np.stack([(np.arange(256) >> (2 * i) & 3) + 1 for i in range(4)], axis=1).astype(np.uint8)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of some 32-bit ranks."""
    r = ranks.astype(np.uint32)
    n = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    padded[: len(n)] = n
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) <= n[:, None]].tobytes()


def unpack_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(length, dtype=np.int64) - length
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    out = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return out


_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_FIRST = _ASCII.copy()  # a byte that starts a character that is surely not white space
_FIRST[0xC3:0xE1] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b',.!?;:)"')] = True


def _last(at: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely not white space."""
    last, before = buf[at - 1], buf[at - 2]
    return _ASCII[last] | ((last >= 0x80) & (before >= 0xC3) & (before <= 0xDF))


def _cuts(laid: Laid) -> np.ndarray:
    """Places inside texts at which byte-level vocabularies always part: before a single space
    between two characters, around a single newline between two, and before a punctuation
    mark after a Latin letter."""
    buf = laid.buf
    edge = np.zeros(len(buf), bool)
    edge[laid.begin - 1] = edge[-1] = True
    space = np.flatnonzero((buf == 0x20) & ~edge)
    space = space[_last(space, buf) & _FIRST[buf[space + 1]]]
    line = np.flatnonzero(buf == 0x0A)
    line = line[_last(line, buf) & _FIRST[buf[line + 1]]]
    mark = np.flatnonzero(_MARK[buf])
    x, w = buf[mark - 1], buf[mark - 2]
    mark = mark[_LETTER[x] | ((w == 0xC3) & (x >= 0x80) & (x < 0xC0) & (x != 0x97) & (x != 0xB7))]
    return np.concatenate([space, line, line + 1, mark])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Encoder:
    """Encodes whole texts by their distinct pieces, which it keeps with their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = t = Tokenizer.from_file(path)
        kind = repr(t.pre_tokenizer)
        # only byte-level vocabularies that leave texts as they are have pieces on their own
        self.splits = t.normalizer is None and kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind
        special = {i: len(a.content.encode()) for i, a in t.get_added_tokens_decoder().items()}
        vocab = t.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes that an id stands for
        for token, i in vocab.items():
            self.width[i] = special.get(i, len(token))
        self.slots: dict[int, int] = {}
        self.keys, self.uses = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.begin, self.count, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0

    def _forget(self) -> None:
        """Drops the pieces that one run only has had, or all if that leaves too many."""
        k = len(self.slots)
        keep = np.flatnonzero(self.uses[:k] > 1)
        keep = keep if len(keep) < CACHE // 2 else keep[:0]
        size = self.count[keep].astype(np.int64)
        upto = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.begin[keep] - upto, size) + np.arange(int(size.sum()))]
        self.keys[: len(keep)], self.begin[: len(keep)], self.count[: len(keep)], self.uses[: len(keep)] = self.keys[keep], upto, size, 1
        self.flat[: len(ids)] = ids
        self.used = len(ids)
        self.slots = dict(zip(self.keys[: len(keep)].tolist(), range(len(keep)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and how many each text has."""
        laid = Laid(data, offsets)
        buf = laid.buf
        starts, ends = laid.begin, laid.end
        if self.splits:
            cut = _cuts(laid)
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        keys, first, number = np.unique(laid.span_hash(starts, ends) + (ends - starts).astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.slots) + len(keys) > CACHE:
            self._forget()
        slot = np.array([self.slots.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            flat, begin, size = self._encode_new(buf, starts[first[new]], ends[first[new]])
            k, more = len(self.slots), len(flat)
            slot[new] = np.arange(k, k + len(new))
            self.begin = _room(self.begin, k + len(new))
            self.count = _room(self.count, k + len(new))
            self.flat = _room(self.flat, self.used + more)
            self.keys, self.uses = _room(self.keys, k + len(new)), _room(self.uses, k + len(new))
            self.keys[k : k + len(new)], self.uses[k : k + len(new)] = keys[new], 0
            self.begin[k : k + len(new)] = self.used + begin
            self.count[k : k + len(new)] = size
            self.flat[self.used : self.used + more] = flat
            self.used += more
            self.slots.update(zip(keys[new].tolist(), slot[new].tolist(), strict=True))
        self.uses[slot] += 1
        piece = slot[number.ravel()]
        size = self.count[piece].astype(np.int64)
        begin = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.begin[piece] - begin, size) + np.arange(int(size.sum()))]
        upto = np.append(0, np.cumsum(size))
        return ids, upto[np.searchsorted(starts, laid.end, "right")] - upto[np.searchsorted(starts, laid.begin)]

    def _in_turn(self, items: list, text_of) -> Iterator[tuple]:
        """Each item with the ids of its text, a few at a time: the library's results are large."""
        for a in range(0, len(items), 16):
            some = items[a : a + 16]
            for x, e in zip(some, self.tokenizer.encode_batch_fast([text_of(x) for x in some], add_special_tokens=False), strict=True):
                yield x, np.array(e.ids, np.uint32)

    def _encode_new(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some pieces: all ids, and where each piece's begin and how many they are.

        Pieces without white space but a first space are encoded a few hundred at a time,
        those without that space after a newline; their ends are found by their bytes."""
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        size = ends - starts
        head, last, before = buf[starts], buf[ends - 1], buf[ends - 2]
        ok = (size > 1) & (_ASCII[last] | ((last >= 0x80) & (before >= 0xC3) & (before <= 0xDF))) & ((head == 0x20) | _FIRST[head])
        side = np.flatnonzero(ok) if self.splits else np.zeros(0, np.int64)
        alone = [np.flatnonzero(~ok)] if self.splits else [np.arange(len(starts))]
        line = (head[side] != 0x20).astype(np.int64)
        length = size[side] + line
        upto = np.cumsum(length)
        text = np.full(int(upto[-1]) if len(side) else 0, 0x0A, np.uint8)
        step = np.arange(int(size[side].sum())) - np.repeat(np.cumsum(size[side]) - size[side], size[side])
        text[np.repeat(upto - length + line, size[side]) + step] = buf[np.repeat(starts[side], size[side]) + step]
        flat, used = [], 0
        chunks = [(a, min(a + 500, len(side)), int(upto[a - 1]) if a else 0) for a in range(0, len(side), 500)]
        said = lambda x: text[x[2] : int(upto[x[1] - 1])].tobytes().decode("utf-8", "replace")
        for (a, b, low), ids in self._in_turn(chunks, said):
            reach, bound = np.cumsum(self.width[ids]), upto[a:b] - low
            cut = np.searchsorted(reach, bound)
            first = np.append(0, cut[:-1] + 1)
            if len(ids) and reach[-1] == bound[-1] and (reach[cut] == bound).all() and (self.width[ids[first[line[a:b] == 1]]] == 1).all():
                begin[side[a:b]] = used + first + line[a:b]
                count[side[a:b]] = cut + 1 - first - line[a:b]
                flat.append(ids)
                used += len(ids)
            else:
                alone.append(side[a:b])
        rest = np.concatenate(alone)
        if len(rest):
            for i, ids in self._in_turn(rest.tolist(), lambda i: buf[starts[i] : ends[i]].tobytes().decode("utf-8", "replace")):
                begin[i], count[i] = used, len(ids)
                flat.append(ids)
                used += len(ids)
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), begin, count


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and the ids of the whole text, the end id last, as 32-bit numbers in bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in runs(offsets, RUN_BYTES):
                ids, size = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                upto = np.cumsum(size)
                ids = np.insert(ids, upto, end_id).astype("<u4")
                upto = np.append(0, upto + np.arange(1, b - a + 1))
                held = ids.astype("<u2") if int(ids.max(initial=0)) < 1 << 16 else ids
                blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((upto * held.itemsize).astype(np.int32).tobytes()), pa.py_buffer(held.tobytes())])
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(crc, pa.int64()), pa.array(np.diff(upto)), blobs], ["doc_id", "crc", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, crc bigint, n_tokens bigint, ids binary")


def _wide(blob: bytes, count: int) -> np.ndarray:
    """Ids held in two or four bytes each."""
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * count else "<u4").astype(np.uint32)


def ranking(ids: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first (then smaller first): as many as the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            ids = [_wide(blob, n) for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            part = np.bincount(np.concatenate(ids) if ids else np.zeros(0, np.int64), minlength=len(total))
            part[: len(total)] += total
            total = part
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have], pa.int64())], ["id", "n"])

    rows = ids.select("n_tokens", "ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))], np.int64)


#: A block: its shard, the shard's ids before it, its documents and their numbers of ids, and the ids.
FIELDS = ["shard", "begin", "doc_ids", "sizes", "count", "control", "data"]


def write(docs: DataFrame, target: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Writes token files of ``docs`` (doc_id, text) in ascending order of doc_id."""
    spark = docs.sparkSession
    ids = store.table(encoded(docs, tokenizer, end_id), "ids", "zstd")
    ranks = ranking(ids)
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(ranks)), pa.int64()), "id": pa.array(ranks, pa.int64())})).coalesce(1).write.parquet(f"{target}/ranks")
    of = np.zeros(int(ranks.max(initial=0)) + 1, np.uint32)
    of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    table_of = spark.sparkContext.broadcast(of)  # at most as many numbers as the vocabulary has ids
    size = int(str(ids._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, held, size = 0, [], 0
        for batch in batches:
            shard = batch.column(0)[0].as_py() if len(batch) else 0
            for d, m, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held.append((d, m, blob))
                size += m
                if size >= BLOCK_IDS:
                    yield done(shard, begin, held)
                    begin, held, size = begin + size, [], 0
        if held:
            yield done(shard, begin, held)

    def done(shard: int, begin: int, held: list) -> pa.RecordBatch:
        all_ids = np.concatenate([_wide(b, m) for _, m, b in held])
        control, data = pack_ranks(table_of.value[all_ids])
        row = [[shard], [begin], [[d for d, _, _ in held]], [np.array([m for _, m, _ in held], "<u4").tobytes()], [len(all_ids)], [control], [data]]
        kinds = [pa.int32(), pa.int64(), pa.list_(id_kind), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], FIELDS)

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    ranged = ids.repartitionByRange(n, "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    numbered = ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "ids")
    schema = f"shard int, begin bigint, doc_ids array<{kind}>, sizes binary, count bigint, control binary, data binary"
    numbered.mapInArrow(block, schema).write.option("compression", "zstd").parquet(f"{target}/blocks")
    store.drop(ids)


def read(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document."""
    return _decoded(spark, target, "ids array<bigint>", digest=False)


def digests(spark: SparkSession, target: str) -> DataFrame:
    """The same with the CRC-32 of the ids, as little-endian 32-bit numbers, in their place."""
    return _decoded(spark, target, "ids_crc32 bigint", digest=True)


def _decoded(spark: SparkSession, target: str, value_field: str, digest: bool) -> DataFrame:
    blocks = spark.read.parquet(f"{target}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema, last = f"doc_id {kind}, start bigint, n_tokens bigint, {value_field}", value_field.split(" ")[0]
    ranks = spark.read.parquet(f"{target}/ranks").orderBy("rank").collect()
    id_of = spark.sparkContext.broadcast(np.array([r[1] for r in ranks], np.uint32))  # the vocabulary's size at most
    # one total a shard; a shard's ids start after those of the shards before
    totals = blocks.groupBy("shard").agg(F.sum("count")).collect()
    counts = np.zeros(1 + max((r[0] for r in totals), default=0), np.int64)
    counts[[r[0] for r in totals]] = [r[1] for r in totals]
    starts = spark.sparkContext.broadcast(np.cumsum(counts) - counts)  # eight bytes for each SHARD_BYTES of ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, begin, doc_ids, sizes, count, control, data in zip(*batch.columns, strict=True):
                ids = id_of.value[unpack_ranks(control.as_py(), data.as_py(), count.as_py())].astype("<u4")
                size = np.frombuffer(sizes.as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(size)
                cut = [ids[e - m : e] for e, m in zip(ends.tolist(), size.tolist(), strict=True)]
                value = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in cut], pa.list_(pa.int64()))
                first = int(starts.value[shard.as_py()]) + begin.as_py()
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(first + ends - size), pa.array(size), value], ["doc_id", "start", "n_tokens", last])

    return blocks.select(*FIELDS).mapInArrow(decode, schema)
