"""Exact n-gram Jaccard join by prefix trees, as connected classes of documents.

A document's set holds its distinct 5-word shingles (of fewer words, the whole sequence as
one; without words it is empty and linked with nothing), as 48-bit hashes.  Two documents link
when ``100 * intersection >= percent * union``.  No candidate is left out and none sampled:

1. Equal sets share one key, so copies are one set from here on.
2. A set linked to another shares at least ``percent`` of its shingles with it.  A task first looks for
   shingles that two of its own sets have; of each such shingle it sends one marker, of the others their set,
   to the bucket of the hash range.  So a shingle that a third of all documents have meets as one entry a
   run of documents.  Sets with too many shingles of their own drop out.
3. Among the sets left, shingles are ordered by how many sets have them, rarest first (counted in runs
   again).  Linked sets share one of their first ``n - ceil(percent * n / 100) + 1`` shingles (their prefix), so
   sets joined by chains of shared prefix shingles form groups, and every link is inside a group.
4. Each group is stored as a path-compressed prefix tree of its ordered sets.  For each set the
   tree is walked, sharing partial overlaps among all sets below a node, and a subtree is left once
   the shingles that remain can't bring the overlap to what the sizes ask for.
   Subtrees already known to be in the set's own class are skipped: they can't change it.
5. A group over ``GROUP_TOKENS`` is first cut into parts that are walked one by one, then the classes' first sets
   are.  Prefix shingles whose sets are all in one class by then can't add a link and are dropped; what still
   hangs together by the others forms new, smaller groups.  Those that are still too large are cut into
   blocks by size, and each two blocks that sizes allow are walked together.  A large group of near copies thus
   costs each set a walk or two, and no task holds more than a group.

Only distinct sets leave their tasks, as packed arrays; texts are never shuffled.  A
filter of fixed size (``FILTER_BITS``, whatever the input) over the keys left after step 2 saves most sets the way
to step 3; an exact join follows it, so that the filter's mistakes cost time only.

Edge cases: null or empty texts, and those of white space alone, have 0 shingles and are a class
of their own; rows with equal ids stay separate rows; a class's id is its smallest document id, null
if all are null; an empty table gives an empty result; ``classes`` returns doc_id, text_hash, n_shingles and
component_id whatever other columns there are, ``one_of_each`` keeps all columns as they were.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .arrays import Laid, mix, runs, utf8, window_hash

SHINGLE = 5
PERCENT = 75
RUN_BYTES = 1 << 20
#: Shingles of one bucket held by one task: buckets are added as the input grows.
BUCKET_BYTES = 8 << 20
#: Shingles that a task gathers before it hands them on.
FLUSH = 1_000_000
#: Most shingles of one prefix tree.
GROUP_TOKENS = 400_000
#: Bits of the filter over keys, at most.
FILTER_BITS = 1 << 27

_LOW48 = np.uint64((1 << 48) - 1)
_LOW32 = np.uint64((1 << 32) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, cuts, shingles): row i has the sorted distinct shingles[cuts[i]:cuts[i + 1]]."""
    for i, j in runs(offsets, RUN_BYTES):
        for a in range(i, j, 60_000):  # row numbers take 16 bits below
            b = min(j, a + 60_000)
            laid = Laid(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
            starts, ends = laid.words()
            first = laid.first_of(starts)
            words = laid.span_hash(starts, ends)
            count = np.diff(first)
            owner = np.repeat(np.arange(laid.n), count)
            found, rows = [], []
            h = window_hash(words, k)
            if len(h):
                whole = np.flatnonzero(owner[: len(h)] == owner[k - 1 : k - 1 + len(h)])
                found.append(h[whole])
                rows.append(owner[whole])
            for m in range(1, k):
                few = np.flatnonzero(count == m)
                if len(few):
                    at = (first[few][:, None] + np.arange(m)).ravel()
                    found.append(window_hash(words[at], m)[::m])
                    rows.append(few)
            if found:
                keyed = np.concatenate(rows).astype(np.uint64) << np.uint64(48) | np.concatenate(found) >> np.uint64(16)
                keyed.sort()
                keyed = keyed[np.append(True, keyed[1:] != keyed[:-1])] if len(keyed) else keyed
            else:
                keyed = np.zeros(0, np.uint64)
            cuts = np.searchsorted(keyed, np.arange(laid.n + 1, dtype=np.uint64) << np.uint64(48))
            yield a, cuts, keyed & _LOW48


def set_keys(cuts: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets; 0 for the empty one."""
    out = np.zeros(len(cuts) - 1, np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(shingles + np.uint64(0x632BE59BD9B4E019)), cuts[:-1][full]) + np.diff(cuts)[full].astype(np.uint64))
    return out


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _measured(df: DataFrame) -> tuple[DataFrame, int]:
    """A frame and its size as Spark sees it; one whose size Spark can't tell is written first."""
    if _size(df) > 1 << 60:
        df = store.table(df, "texts")
    return df, _size(df)


def _buckets(spark: SparkSession, size: int) -> int:
    return min((1 << 31) - 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES, 1))


def _bucket(items: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each shingle: equal ranges of its high 32 bits."""
    return ((items >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _cut(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the stretches of a sorted array."""
    edge = np.flatnonzero(_new(bucket)).tolist()
    for a, b in zip(edge, [*edge[1:], len(bucket)][: len(edge)], strict=True):
        yield int(bucket[a]), a, b


def _table(rows: list[tuple], kinds: tuple[tuple[str, pa.DataType], ...]) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds)})


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(column)), kind)


def _slots(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of the keys by the slot that they are gathered in."""
    slot = (mix(keys) % np.uint64(n)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    for s, a, b in _cut(slot[order]):
        yield s, order[a:b]


def _new(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array."""
    return np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)


_SENT = (("bucket", pa.int32()), ("run", pa.int64()), ("keys", pa.binary()), ("items", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary()))
SENT = "bucket int, run bigint, keys binary, items binary, sets binary, sizes binary"


class _Run:
    """Gathers sets and hands on what other runs must know of them.

    A row has, for a bucket, the low 32 bits of shingles (``items``) and the set of each (``keys``), or 0 where
    two sets of this run have the shingle.  ``sets`` and ``sizes`` have each set once, in any of the rows: (shingles
    shared within the run, all shingles).  Bucket and low bits of two shingles may agree, which can only make a
    shingle look shared: no set is lost by it."""

    def __init__(self, n: int):
        self.n, self.keys, self.sizes, self.items, self.held, self.sets = n, [], [], [], 0, 0

    def add(self, keys: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> None:
        self.keys.append(keys)
        self.sizes.append(sizes)
        self.items.append(items)
        self.held += len(items)
        self.sets += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, sizes, items = np.concatenate(self.keys), np.concatenate(self.sizes).astype(np.int64), np.concatenate(self.items)
        self.keys, self.sizes, self.items, self.held, self.sets = [], [], [], 0, 0
        # a shingle and its set's number (of 16 bits) in one word: sorting the words sorts by shingle
        packed = items << np.uint64(16) | np.repeat(np.arange(len(keys), dtype=np.uint64), sizes)
        packed.sort()
        items, owner = packed >> np.uint64(16), (packed & np.uint64(0xFFFF)).astype(np.int64)
        first = _new(items)
        many = np.diff(np.append(np.flatnonzero(first), len(items)))
        shared = np.bincount(owner[np.repeat(many, many) > 1], minlength=len(keys))
        # by value, hence by bucket; a set is in a run once, so a shingle's owners differ
        items, owner, many = items[first], owner[first], many
        names = np.where(many > 1, np.uint64(0), keys[owner])
        bucket, run = _bucket(items, self.n), int.from_bytes(os.urandom(8), "little", signed=True)
        home = np.argsort(keys, kind="stable")
        cuts = list(_cut(bucket))
        ends = np.linspace(0, len(keys), len(cuts) + 1).astype(int).tolist()
        low = (items & _LOW32).astype(np.uint32)
        counts = np.stack([shared, sizes], axis=1).astype(np.uint32)
        rows = [(k, run, names[a:b].tobytes(), low[a:b].tobytes(), keys[home[e:f]].tobytes(), counts[home[e:f]].tobytes()) for (k, a, b), e, f in zip(cuts, ends[:-1], ends[1:], strict=True)]
        yield from _table(rows, _SENT).to_batches()


def _shared_keys(sent: DataFrame, percent: int, n: int) -> DataFrame:
    """Keys of the sets of which enough shingles are in another set too."""
    kinds = (("slot", pa.int32()), ("runs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()))

    def count(table):
        keys, items = _joined(table, "keys", np.uint64), _joined(table, "items", np.uint32)
        length = [len(x.as_py()) // 4 for x in table.column("items")]
        run = np.repeat(np.array(table.column("run")), length)
        packed = items.astype(np.uint64) << np.uint64(32) | np.arange(len(items), dtype=np.uint64)
        packed.sort()
        order = (packed & _LOW32).astype(np.int64)
        keys, run = keys[order], run[order]
        first = _new(packed >> np.uint64(32))
        edge = np.flatnonzero(first)
        # shared: a marker, or two sets
        least, most = (f.reduceat(keys, edge) if len(edge) else keys for f in (np.minimum, np.maximum))
        hit = ((least == 0) | (least != most))[np.cumsum(first) - 1] & (keys != 0)
        said = [_joined(table, "sets", np.uint64), _joined(table, "sizes", np.uint32).reshape(-1, 2)]
        runs_of = np.repeat(np.array(table.column("run")), [len(x.as_py()) // 8 for x in table.column("sets")])
        k = np.concatenate([keys[hit], said[0]])
        r = np.concatenate([run[hit], runs_of])
        c = np.concatenate([np.stack([np.ones(int(hit.sum()), np.uint32), np.zeros(int(hit.sum()), np.uint32)], axis=1), said[1]])
        return _table(_by_slot(k, r, c, n), kinds)

    def total(table):
        keys, run, counts = _summed(_joined(table, "keys", np.uint64), _joined(table, "runs", np.int64), _joined(table, "counts", np.uint32).reshape(-1, 2))
        # each run that has the set gives its whole count
        enough = 100 * counts[:, 0].astype(np.int64) >= percent * counts[:, 1].astype(np.int64)
        return pa.table({"key": np.unique(keys[enough & (counts[:, 1] > 0)]).view(np.int64)})

    return sent.groupBy("bucket").applyInArrow(count, "slot int, runs binary, keys binary, counts binary").groupBy("slot").applyInArrow(total, "key bigint")


def _summed(keys: np.ndarray, run: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up by set and run."""
    if not len(keys):
        return keys, run, counts.astype(np.uint32)
    order = np.lexsort((run, keys))
    keys, run, counts = keys[order], run[order], counts[order]
    edge = np.flatnonzero(_new(keys) | _new(run))
    return keys[edge], run[edge], np.add.reduceat(counts.astype(np.int64), edge, axis=0).astype(np.uint32)


def _by_slot(keys: np.ndarray, run: np.ndarray, counts: np.ndarray, n: int) -> list[tuple]:
    keys, run, counts = _summed(keys, run, counts)
    return [(slot, run[x].tobytes(), keys[x].tobytes(), counts[x].tobytes()) for slot, x in _slots(keys, n)]


def _filter(keys: DataFrame) -> tuple[int, dict[int, bytes]]:
    """A bitmap over the keys, of at most FILTER_BITS bits: (bits, its pages of 4 KB)."""
    n = keys.count()
    bits = 1 << 20
    while bits < 24 * n and bits < FILTER_BITS:
        bits <<= 1
    at = F.pmod(F.col("key"), F.lit(bits))
    pages = keys.groupBy((at / 32768).cast("int").alias("page")).agg(F.expr(f"bitmap_construct_agg(pmod(key, {bits}) % 32768)").alias("b"))
    return bits, {r[0]: bytes(r[1]) for r in pages.collect()}


def _shingled(docs: DataFrame, k: int, n: int) -> DataFrame:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = _Run(n), set()
        for batch in batches:
            for _, cuts, shingles in shingle_sets(*utf8(batch.column(0)), k):
                keys, size = set_keys(cuts, shingles), np.diff(cuts)
                new = np.zeros(len(keys), bool)
                for i, x in enumerate(keys.tolist()):  # copies within a task count once
                    if size[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                if out.sets + int(new.sum()) > 1 << 16:  # sets' numbers take 16 bits in a run
                    yield from out.flush()
                out.add(keys[new], size[new], shingles[np.repeat(new, size)])
                if out.held >= FLUSH:
                    yield from out.flush()
                    if len(seen) > 2_000_000:
                        seen.clear()
        yield from out.flush()

    return docs.mapInArrow(parts, SENT)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """One row a document: its id, ``text_hash``, n_shingles and component_id."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    narrow, size = _measured(narrow)
    n = _buckets(spark, size)
    shared = store.table(_shared_keys(_shingled(narrow.select("text"), k, n), percent, n), "shared")
    bits, pages = _filter(shared)
    page_of = spark.sparkContext.broadcast(pages)  # at most FILTER_BITS bits

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bitmap = np.zeros(bits >> 3, np.uint8)
        for page, b in page_of.value.items():
            bitmap[page << 12 : (page << 12) + len(b)] = np.frombuffer(b, np.uint8)
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for a, cuts, shingles in shingle_sets(*utf8(batch.column(2)), k):
                keys, size = set_keys(cuts, shingles), np.diff(cuts)
                at = keys % np.uint64(bits)
                hit = (bitmap[(at >> np.uint64(3)).astype(np.intp)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (size > 0)
                sets: list[bytes | None] = [None] * len(keys)
                for i in np.flatnonzero(hit).tolist():
                    x = int(keys[i])
                    if x not in seen:
                        seen.add(x)
                        sets[i] = shingles[cuts[i] : cuts[i + 1]].tobytes()
                if len(seen) > 2_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(keys)), hashes.slice(a, len(keys)), pa.array(size, pa.int64()), pa.array(keys.view(np.int64)), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "n_shingles", "key", "items"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    read = narrow.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    all_docs = store.table(read.mapInArrow(fetch, f"doc_id {kind}, text_hash bigint, n_shingles bigint, key bigint, items binary"), "sets")
    sets = all_docs.where(F.col("items").isNotNull()).select("key", "n_shingles", "items").join(shared, "key", "left_semi")
    roots = _roots(sets, n, percent)
    narrow_docs = all_docs.select("doc_id", "text_hash", "n_shingles", "key")
    least = narrow_docs.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least")).join(roots, "key", "left")
    least = least.select("key", F.coalesce("root", "key").alias("root"), "least")
    classes_ = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = store.table(least.join(classes_, "root").select(F.col("key").alias("_key"), "component_id"), "classes")
    out = narrow_docs.join(by_key, (F.col("key") == F.col("_key")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _prefix(n: np.ndarray | int, percent: int):
    """Shingles of a set of n from the first of which a linked set must have one."""
    return n - -(-n * percent // 100) + 1


_KEPT = (("run", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("items", pa.binary()))
_ASKED = (("bucket", pa.int32()), ("run", pa.int64()), ("items", pa.binary()), ("counts", pa.binary()))


def _ordered(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Each set's shingles that another set has too, in the common order (rarest first), and its prefix of them.

    Sets are kept in runs; a run asks each bucket once for the frequencies of its distinct shingles, so that
    no shingle brings more than an entry a run to one task."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, items, held = [], [], [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((int.from_bytes(os.urandom(8), "little", signed=True), np.array(keys, np.int64).tobytes(), np.array(sizes, np.uint32).tobytes(), b"".join(items)), _KEPT, strict=True)], [c for c, _ in _KEPT])

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                sizes.append(len(x) // 8)
                items.append(x)
                held += len(x) // 8
                if held >= FLUSH // 4:
                    yield done()
                    keys, sizes, items, held = [], [], [], 0
        if keys:
            yield done()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items, counts = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                rows = [(k, run, items[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for k, a, b in _cut(_bucket(items, n))]
                yield from _table(rows, _ASKED).to_batches()

    def answer(table):
        items, counts = _joined(table, "items", np.uint64), _joined(table, "counts", np.uint32)
        distinct, number = np.unique(items, return_inverse=True)
        often = np.bincount(number, counts, len(distinct)).astype(np.int64)[number]
        cuts = np.append(0, np.cumsum([len(x.as_py()) // 8 for x in table.column("items")]))
        # below its frequency, as far as 16 bits go; a shingle of one set alone isn't told
        tagged = np.minimum(often, 0xFFFF).astype(np.uint64) << np.uint64(48) | items
        rows = [(run, tagged[a:b][often[a:b] > 1].tobytes()) for run, a, b in zip(table.column("run").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return _table(rows, (("run", pa.int64()), ("tagged", pa.binary())))

    kinds = (("key", pa.int64()), ("n_shingles", pa.int64()), ("items", pa.binary()), ("prefix", pa.list_(pa.int64())), ("n_items", pa.int64()))

    def place(mine, told):
        tagged = np.sort(_joined(told, "tagged", np.uint64) & _LOW48) if told.num_rows else np.zeros(0, np.uint64)
        full = _joined(told, "tagged", np.uint64) if told.num_rows else tagged
        full = full[np.argsort(full & _LOW48, kind="stable")]
        rows = []
        for keys, sizes, items in zip(mine.column("keys").to_pylist(), mine.column("sizes").to_pylist(), mine.column("items").to_pylist(), strict=True):
            keys, sizes, items = np.frombuffer(keys, np.int64), np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(items, np.uint64)
            at = np.searchsorted(tagged, items)
            found = at < len(tagged)
            found[found] = tagged[at[found]] == items[found]
            owner = np.repeat(np.arange(len(keys)), sizes)[found]
            got = full[at[found]]
            order = np.lexsort((got, owner))
            got, kept = got[order], np.bincount(owner, minlength=len(keys))
            cuts = np.append(0, np.cumsum(kept))
            first = _prefix(sizes, percent) - (sizes - kept)  # rarer ones, of one set alone, come before
            rows += [(int(keys[i]), int(sizes[i]), got[cuts[i] : cuts[i + 1]].tobytes(), got[cuts[i] : cuts[i] + min(first[i], kept[i])].view(np.int64), int(kept[i])) for i in np.flatnonzero((first > 0) & (kept > 0)).tolist()]
        return _table(rows, kinds)

    runs_ = store.table(sets.select("key", "items").dropDuplicates(["key"]).mapInArrow(keep, "run bigint, keys binary, sizes binary, items binary"), "runs")
    told = runs_.select("run", "items").mapInArrow(ask, "bucket int, run bigint, items binary, counts binary").groupBy("bucket").applyInArrow(answer, "run bigint, tagged binary")
    out = runs_.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(place, "key bigint, n_shingles bigint, items binary, prefix array<bigint>, n_items bigint")
    out = store.table(out, "ordered")
    store.drop(runs_)
    return out


def _edges(ordered: DataFrame) -> DataFrame:
    """key, token: chains of these hang together just as the sets' prefixes do.

    Of the sets of a run that have a shingle, one alone is joined with the shingle, the others with that one."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys = np.repeat(np.array(batch.column(0)), np.diff(np.array(lists.offsets)))
            tokens = np.array(lists.flatten())
            order = np.lexsort((keys, tokens))
            keys, tokens = keys[order], tokens[order]
            first = _new(tokens)
            low = keys[first][np.cumsum(first) - 1] if len(keys) else keys
            near = np.unique(np.stack([keys[~first], low[~first]], axis=1), axis=0) if (~first).any() else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[first], near[:, 0]])), pa.array(np.concatenate([tokens[first], near[:, 1]])), pa.array(np.append(np.zeros(int(first.sum()), bool), np.ones(len(near), bool)))], ["key", "token", "near"])

    found = store.table(ordered.select("key", "prefix").mapInArrow(reduce, "key bigint, token bigint, near boolean"), "edges")
    # a shingle's sets hang together by its smallest; most shingles say the same as another
    told = found.where("not near").select("key", "token")
    low = told.groupBy("token").agg(F.min("key").alias("low"))
    far = told.join(low, "token").where("key <> low").select("key", F.col("low").alias("token"))
    star = store.table(far.union(found.where("near").select("key", "token")).distinct(), "star")
    return star.union(star.select(F.col("token").alias("key"), "token"))


def _grouped(rows: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of two sets and more with their group's root and size: small ones, and large ones."""
    grouped = rows.drop("root").join(groups, "key")
    size = grouped.groupBy("root").agg(F.sum("n_items").alias("tokens"), F.count(F.lit(1)).alias("members")).where("members > 1")
    out = grouped.join(size, "root")
    return out.where(F.col("tokens") <= GROUP_TOKENS), out.where(F.col("tokens") > GROUP_TOKENS)


def _both(links: DataFrame) -> DataFrame:
    """Links (key, root) as edges of ``connected``."""
    return links.select("key", F.col("root").alias("token")).union(links.select(F.col("root").alias("key"), F.col("root").alias("token"))).distinct()


def _roots(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """key -> root for the sets that are linked to another."""
    ordered = _ordered(sets, n, percent)
    small, large = _grouped(ordered.drop("prefix"), connected(_edges(ordered)))
    block = lambda rows, by: rows.select(by.alias("block"), "key", "n_shingles", "items")
    links = _walk(block(small, F.col("root")), n, percent)
    large = store.table(large.select("key", "root", "n_shingles", "items", "n_items", "tokens"), "large")
    if large.isEmpty():
        return links
    # parts first, then the classes' first sets
    parts = F.ceil(F.col("tokens") / F.lit(0.8 * GROUP_TOKENS)).cast("int")
    within = store.table(_walk(block(large, F.xxhash64("root", F.pmod(F.xxhash64("key"), parts))), n, percent), "within")
    named = large.join(within.withColumnRenamed("root", "cls"), "key", "left").withColumn("cls", F.coalesce("cls", "key"))
    heads, many = _grouped(named.where(F.col("cls") == F.col("key")).drop("cls", "tokens"), large.select("key", "root"))
    across = _walk(block(heads.unionByName(many.withColumn("root", F.xxhash64("root", F.pmod(F.xxhash64("key"), F.ceil(F.col("tokens") / F.lit(0.8 * GROUP_TOKENS)).cast("int"))))), F.col("root")), n, percent)
    known = store.table(within.union(across), "known")
    classes_ = connected(_both(known))
    # shingles that sets of two classes have
    told = ordered.join(large.select("key"), "key", "left_semi").select("key", "prefix").join(classes_.withColumnRenamed("root", "cls"), "key", "left")
    told = told.select("key", F.coalesce("cls", "key").alias("cls"), F.explode("prefix").alias("token"))
    live = told.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("token")
    left = store.table(told.join(live, "token").groupBy("key").agg(F.collect_list("token").alias("prefix")), "left")
    if left.isEmpty():
        return links.union(classes_)
    rest, blocks = _grouped(large.drop("tokens"), connected(_edges(left)))
    found = _walk(block(rest, F.col("root")), n, percent)
    found = store.table(found.union(_walk(_blocks(blocks, percent), n, percent)), "links")
    return links.union(connected(_both(known.union(found))))


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of large groups, once for each two blocks that hold them and whose sizes may link.

    Blocks hold sets of like size: a set's block is its size class and, in there, one of as many
    parts as the class needs."""
    half = GROUP_TOKENS // 2
    grade = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = rows.withColumn("grade", grade)
    need = rows.groupBy("root", "grade").agg(F.ceil(F.sum("n_items") / F.lit(half * 0.8)).cast("int").alias("parts"))
    placed = rows.join(need, ["root", "grade"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # linked sets differ by at most one size class; the pair is (lower, upper), each list a row of `need`
    near = need.select(F.col("root").alias("r2"), F.col("grade").alias("g2"), F.col("parts").alias("p2"))
    pairs = placed.join(near, (F.col("root") == F.col("r2")) & F.col("g2").between(F.col("grade") - 1, F.col("grade") + 1))
    pairs = pairs.withColumn("q2", F.explode(F.sequence(F.lit(0), F.col("p2") - 1)))
    me, other = F.struct("grade", "part"), F.struct(F.col("g2").alias("grade"), F.col("q2").alias("part"))
    return pairs.select(F.xxhash64("root", F.least(me, other), F.greatest(me, other)).alias("block"), "key", "n_shingles", "items")


def connected(edges: DataFrame) -> DataFrame:
    """key -> root of the keys joined by chains of shared tokens (edges: key, token).

    Each round takes every key's smallest label within its tokens, then the label's label."""
    labels = store.table(edges.select("key").distinct().select("key", F.col("key").alias("root")), "labels")
    while True:
        least = edges.join(labels, "key").groupBy("token").agg(F.min("root").alias("low"))
        near = edges.join(least, "token").groupBy("key").agg(F.min("low").alias("low"))
        jump = near.join(labels.select(F.col("key").alias("low"), F.col("root").alias("far")), "low").select("key", "low", F.least("low", "far").alias("root"))
        new = store.table(jump.join(labels.withColumnRenamed("root", "old"), "key").select("key", "root", (F.col("root") != F.col("old")).alias("moved")), "labels")
        store.drop(labels)
        moved = not new.where("moved").isEmpty()
        keep = new.select("key", "root")
        keep._veilsight_path = new._veilsight_path
        labels = keep
        if not moved:
            return labels


def _walk(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Runs each block's tree; key -> root within the block, for linked sets.

    Many blocks are dealt together to one bin, and a bin to one call."""

    def walk(table):
        block, key, size = (np.array(table.column(c)) for c in ("block", "key", "n_shingles"))
        items = table.column("items").to_pylist()
        order = np.lexsort((key, block))
        turn = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
        found_keys, found_roots = [], []
        for part in np.split(order, turn[1:]):
            part = part[np.append(True, key[part][1:] != key[part][:-1])]
            roots = np.array(link([np.frombuffer(items[i], np.uint64) for i in part.tolist()], size[part].tolist(), percent))
            linked = np.bincount(roots, minlength=len(part))[roots] > 1
            found_keys.append(key[part][linked])
            found_roots.append(key[part][roots][linked])
        return pa.table({"key": np.concatenate(found_keys), "root": np.concatenate(found_roots)})

    dealt = rows.select(F.pmod(F.xxhash64("block"), F.lit(4 * n)).alias("bin"), "block", "key", "n_shingles", "items")
    return dealt.groupBy("bin").applyInArrow(walk, "key bigint, root bigint")


def link(sets: list[np.ndarray], sizes: list[int], percent: int = PERCENT) -> list[int]:
    """For each set the number of its class's first set.

    ``sets`` are sorted arrays of shingles with their frequency in the high bits; ``sizes`` also
    count the shingles that no other set has."""
    n = len(sets)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # shingles as ranks in the common order
    cuts = np.append(0, np.cumsum([len(s) for s in sets]))
    _, rank = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True)
    seqs = [rank[cuts[i] : cuts[i + 1]] for i in range(n)]
    tree = Tree(seqs, sizes)
    starts: dict[int, list[int]] = {}
    prefixes = []
    for i, s in enumerate(seqs):
        mine = s[: max(0, _prefix(sizes[i], percent) - (sizes[i] - len(s)))].tolist()
        prefixes.append(mine)
        for t in mine:
            starts.setdefault(t, []).append(i)
    mark = np.zeros(int(rank.max(initial=-1)) + 1, bool)
    dead: set[int] = set()  # shingles whose sets are all in one class
    stamp = [-1] * len(tree.label)
    for i in sorted(range(n), key=lambda i: (sizes[i], i)):
        # subtrees with a set that shares a prefix shingle and isn't in this set's class yet
        mine, any_ = find(i), False
        for t in prefixes[i]:
            row = starts[t]
            if len(row) > 1 and t not in dead:
                live = [j for j in row if find(j) != mine]
                if not live:
                    dead.add(t)
                    continue
                for j in live:
                    v = tree.leaf[j]
                    while v >= 0 and stamp[v] != i:
                        stamp[v] = i
                        v = tree.up[v]
                    any_ = True
        if not any_:
            continue
        s = seqs[i]
        mark[s] = True
        todo = [(0, 0)]
        while todo:
            v, over = todo.pop()
            label = tree.label[v]
            if len(label):
                over += int(np.count_nonzero(mark[label]))
                left = len(s) - int(np.searchsorted(s, label[-1], "right"))
            else:
                left = len(s)
            # the most that any set below can share, against the least that sizes ask for
            best = over + min(left, tree.rest[v])
            if (100 + percent) * best < percent * (sizes[i] + max(tree.least[v], -(-percent * sizes[i] // 100))):
                continue
            for j in tree.ends[v]:
                if j != i and (100 + percent) * over >= percent * (sizes[i] + sizes[j]):
                    a, b = find(i), find(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
            todo += [(c, over) for c in tree.down[v] if stamp[c] == i]
        mark[s] = False
    return [find(i) for i in range(n)]


class Tree:
    """A path-compressed prefix tree; node 0 is the root.

    label: the shingles on the way from the parent; ends: the sets that end here;
    rest: the most shingles that follow; least: the smallest size of a set at or below."""

    def __init__(self, seqs: list[np.ndarray], sizes: list[int]):
        self.label, self.up, self.down, self.ends, self.rest, self.least = [np.zeros(0, np.int64)], [-1], [[]], [[]], [0], [0]
        self.leaf = [0] * len(seqs)
        by = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u8").tobytes())
        path, depth = [0], [0]  # nodes from the root to the last set's end, and their depths
        last = np.zeros(0, np.int64)
        for i in by:
            s = seqs[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while len(path) > 1 and depth[-2] >= common:
                path.pop()
                depth.pop()
            if depth[-1] > common:  # cut the edge in two
                low, above = path[-1], path[-2]
                cut = common - depth[-2]
                mid = self._node(above, self.label[low][:cut])
                self.down[above].remove(low)
                self.label[low] = self.label[low][cut:]
                self.up[low] = mid
                self.down[mid].append(low)
                path[-1], depth[-1] = mid, common
            if len(s) > depth[-1]:
                path.append(self._node(path[-1], s[depth[-1] :]))
                depth.append(len(s))
            self.ends[path[-1]].append(i)
            self.leaf[i] = path[-1]
            last = s
        todo, order = [0], []
        while todo:
            v = todo.pop()
            order.append(v)
            todo += self.down[v]
        for v in reversed(order):
            below = [(len(self.label[c]) + self.rest[c], self.least[c]) for c in self.down[v]]
            self.rest[v] = max([0, *(r for r, _ in below)])
            self.least[v] = min([*(sizes[i] for i in self.ends[v]), *(x for _, x in below)], default=0)

    def _node(self, above: int, label: np.ndarray) -> int:
        self.label.append(label)
        self.up.append(above)
        self.down.append([])
        self.ends.append([])
        self.rest.append(0)
        self.least.append(0)
        self.down[above].append(len(self.label) - 1)
        return len(self.label) - 1


def one_of_each(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The documents with one of each class: the one with the smallest id (then text hash), one without an id last.

    Documents without words are all kept."""
    found = store.table(classes(docs, percent=percent, k=k), "found")
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f"), F.count(F.lit(1)).alias("n"))
    keep = store.table(first.select("f.doc_id", "f.text_hash"), "keep")
    again = found.join(keep, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").count().where("count > 1")
    repeated = not again.isEmpty()
    names = docs.columns
    named = keep.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.where(worded).join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_h")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["doc_id", "_text_hash"])
    return kept.select(*names).unionByName(rows.where(~worded).select(*names))
