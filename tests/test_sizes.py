"""What larger tables showed: texts without a spoken value aren't read out, small tables are dealt out, keys beyond six digits."""

import re

import duckdb
import pytest

from veilsight import queries, queries_values, spec
from veilsight.functions import spans
from veilsight.operators.detect import detect

SF = "/root/testdata/sf0.001"


def agrees(spark, name, folder):
    con = duckdb.connect()
    for table in ("orders", "customer", "documents", "pages"):
        if (folder / f"{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want


def test_places_are_those_of_a_plain_search():
    patterns = [spec.CARD_WRITTEN, spec.NINE_WRITTEN, *spec.DATES_WRITTEN]
    made, first = [re.compile(p) for p in patterns], [p in spec.DIGIT_FIRST for p in patterns]
    odd = ["", "x", "1", "4539 1488 0343 6467 04/29", "a123456789 123-45-6789 123 45 6789é", "1/2/1980 1980-1-2 Jan 2nd, 1980 2nd of  January 1980", "٣123456789", "1-2-19801-2-1980", "12.3.80.5 12.3.80", "4539148803436467 27.65.93.188", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"]
    for text in odd + ["\n".join(odd)]:
        assert spans.hits(text, made, first) == sorted((m.start(), m.end(), k) for k, p in enumerate(made) for m in p.finditer(text))


def test_slices_are_bounded():
    import pyarrow as pa

    part = pa.array(["x" * 100_000] * 300 + [None] + ["y"] * 2000)
    cut = list(spans.slices(part))
    assert sum(map(len, cut)) == len(part) and max(c.nbytes for c in cut) <= 2 * spans.BYTES and max(map(len, cut)) <= spans.ROWS
    assert spans.by_slices(part, lambda texts: texts, pa.string()).equals(part) and len(spans.by_slices(part[:0], lambda texts: texts, pa.string())) == 0


def test_digits_alone_are_not_read_out(spark):
    texts = [(1, "order 4539148803436467"), (2, "card four five three nine one four eight eight oh three four three six four six seven"), (3, "born March third nineteen eighty"), (4, "card 4539 1488 uh 0343 6467")]
    rows = detect(spark.createDataFrame(texts, "k int, text string"), now_year=2026)
    assert {(r.k, r.cls, r.status) for r in rows.collect()} == {(1, "card", "suppressed"), (2, "card", "finding"), (3, "dob", "finding"), (4, "card", "finding")}


@pytest.mark.parametrize("made", [queries_values._planted, queries_values._turns])
def test_planted_rows_are_dealt_out(spark, made):
    assert made(spark, SF).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("name", ["conversation_values", "redacted_turns", "stored_values"])
def test_keys_beyond_six_digits(spark, tmp_path, name):
    spark.range(8_999_900, 9_000_020).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    agrees(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["top_findings", "card_brands", "findings_by_source", "report_by_store", "page_card_findings"])
def test_cards_are_whole_runs_as_in_the_sql(spark, tmp_path, name):
    texts = [(1, "pay 4451718024887799 27.65.93.188 now"), (2, "4028005252517056. 27"), (3, "a 4539 1488 0343 6467, 4028005252517056")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source", "'en' AS lang")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    rows.selectExpr("doc_id AS page_id", "text AS html").write.parquet(str(tmp_path / "pages.parquet"))
    agrees(spark, name, tmp_path)


def test_whole_runs_are_asked_for(spark):
    rows = spark.createDataFrame([(1, "card 4539 1488 0343 6467 04/29")], "k int, text string")
    assert [(r.start, r.end) for r in detect(rows, now_year=2026).collect()] == [(5, 24)] and detect(rows, now_year=2026, whole_runs=True).count() == 0


def test_archives_of_many_entries(spark):
    import io
    import tarfile

    from veilsight.sources import archives

    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        for k in range(1200):
            info = tarfile.TarInfo(f"f{k}.txt")
            info.size = 1
            f.addfile(info, io.BytesIO(b"x"))
    raw = t.getvalue()
    files_ = spark.createDataFrame([("whole", bytearray(raw)), ("cut", bytearray(raw[: 1024 * 3 + 700]))], "path string, content binary")
    got = {p: [(r.entry, r.skipped) for r in archives.entries(files_).orderBy("entry_index").collect() if r.path == p] for p in ("whole", "cut")}
    assert got["whole"] == [(f"f{k}.txt", None) for k in range(1200)] and got["cut"][:3] == [(f"f{k}.txt", None) for k in range(3)]
    assert [e[3] for e in archives.entries_of(raw, 2, 100)] == [None, None, "entries"]


def test_items_are_dealt_out_and_leaves_have_what_is_asked_for(spark):
    from veilsight.sources import tagged

    items = queries._items(spark, SF)
    some, all_ = tagged.leaves(items, ["o_orderkey"], "doc", only=("path", "text")), tagged.leaves(items, ["o_orderkey"], "doc")
    assert items.rdd.getNumPartitions() >= 4 and some.columns == ["o_orderkey", "path", "text"]
    assert some.exceptAll(all_.select(*some.columns)).count() == 0 and some.count() == all_.count()


def test_what_is_made_of_a_batch_is_given_back_in_slices(spark):
    from pyspark.sql import functions as F

    from veilsight.sources import json_leaves

    import pyarrow as pa

    made = spans.each_slice(pa.array(["a 1 b 2"] * 5000), lambda texts: [[t] * 50 for t in texts], pa.list_(pa.string()))
    sizes = [len(x) for x in made]
    assert sum(sizes) == 5000 and max(sizes) <= spans.ROWS
    rows = spark.range(5000).coalesce(1).select("id", F.concat(F.lit('{"a":'), "id", F.lit("}")).alias("doc"))
    assert json_leaves.leaves(rows, ["id"], "doc").where("text = cast(id AS STRING)").count() == 5000
    found = rows.select(F.explode(spans.find(F.col("doc"), ["[0-9]+"], 3, 1)).alias("f"), "id")
    assert found.where("f.raw = cast(id AS STRING)").count() == 5000


class Held:
    """States of one key, which count how often the list is read, and its timers."""

    def __init__(self):
        self.states, self.timers, self.reads = {}, set(), 0

    def getListState(self, name, schema):
        return State(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class State:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return bool(self.held.states.get(self.name))

    def get(self):
        self.held.reads += self.name == "waiting"
        value = self.held.states[self.name]
        return iter(list(value)) if self.name == "waiting" else value

    def put(self, value):
        self.held.states[self.name] = list(value)

    def update(self, value):
        self.held.states[self.name] = tuple(value)

    def appendList(self, value):
        self.held.states.setdefault(self.name, []).extend(value)

    def appendValue(self, value):
        self.appendList([value])

    def clear(self):
        self.held.states.pop(self.name, None)


def test_events_of_a_key_are_read_once_a_batch():
    from types import SimpleNamespace

    from veilsight.streaming.sessions import Turns

    held, turns, out = Held(), Turns(1000), []
    turns.init(held)
    events = [(600 * i + (5000 if i >= 1500 else 0), i) for i in range(2000)]
    for some, mark in ((events[:1000][::-1], 500_000), (events[1000:], 900_000), ([], 10**9)):
        list(turns.handleInputRows((7,), iter([SimpleNamespace(at=a, item=i) for a, i in some]), None))
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m)
        for at in sorted(t for t in held.timers if t <= mark):
            if at in held.timers:
                held.timers.discard(at)
                out += turns.handleExpiredTimer((7,), now, None)
    assert [(r.begin, r.turn, r.at, r.item) for r in out] == [((0, i) if i < 1500 else (events[1500][0], i - 1500)) + events[i] for i in range(2000)]
    assert held.reads <= 3 and not held.timers and not held.states


def test_conversations_without_a_turn_are_not_looked_at_again(spark, tmp_path):
    from veilsight.operators import conversation
    from veilsight.streaming.conversations import Conversations

    schema = "conv_id string, turn int, speaker string, text string"
    first = [("a", 0, "bot", "Your card number?"), ("b", 0, "bot", "Account number?"), ("b", 1, "customer", "123"), ("c", 0, "bot", "Account number?")]
    second = [("a", 1, "customer", "4539148803436467")]
    stream = Conversations(spark, str(tmp_path / "talks"), 2026)
    for number, rows in enumerate((first, second)):
        stream.apply(spark.createDataFrame(rows, schema).coalesce(1), number)
    assert {r["conv_id"] for r in stream.work.read().collect()} == {"a"}
    assert {r["conv_id"] for r in stream.held.read().collect()} == {"a", "b", "c"}
    stream.finish()
    assert {r["conv_id"] for r in stream.work.read().collect()} == {"a", "b"}
    want = conversation.classify(spark.createDataFrame(first + second, schema), 2026)
    assert sorted(map(repr, stream.findings().collect())) == sorted(map(repr, want.collect())) != []


def test_stale_parts_are_found_once(spark):
    from pyspark.sql import functions as F

    from veilsight.operators import parts

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marker(k):
        seen.add(1)
        return "m"

    rows = spark.range(400).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("part"), marker("id").alias("marker"), F.lit(1).alias("size"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("sample"))
    index = spark.createDataFrame([], "source string, part string, marker string, profile string")
    found = parts.stale(rows, index, "p")
    assert found.count() == 300 and "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert parts.stale(rows, index, "p", percent=99).count() < 300
    seen.value = 0
    assert parts.stretch(found, 200, 1 << 60).count() == 200
    assert seen.value == 400


def _runs(spark, tmp_path):
    # eighteen and nineteen digits in no printed groups; fillers and number words beside a card; a card digit by digit
    texts = [(1, "call 36 4366089147969129 or 36 4366089147969128"), (2, "er 4539148803436467 um 53, o 4539148803436467"), (3, "two 4539148803436467 one"), (4, "a 4 5 3 9 1 4 8 8 0 3 4 3 6 4 6 7."), (5, "x 6011 0000 0000 12345 6011-000000001234564")]
    for a in range(10):
        texts.append((10 + a, f"n 36 436608914796{a}128, 655 3329641322646528{a}"))
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))


def test_card_brands_counts_runs_however_grouped(spark, tmp_path):
    _runs(spark, tmp_path)
    agrees(spark, "card_brands", tmp_path)


@pytest.mark.parametrize("name", ["report_by_store", "findings_by_source", "top_findings"])
def test_documents_cards_are_written_runs(spark, tmp_path, name):
    _runs(spark, tmp_path)
    agrees(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["set_aside_values", "stored_values", "class_totals"])
def test_no_text_waits_beside_a_function_that_is_given_few(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "looked(" in plan


def test_stretches_are_those_of_a_plain_cut(spark):
    texts = ["", "\n", "ab\n" + "x" * 40, "x" * 40, "x" * 39 + "\n" + "y" * 41, "\n" * 50, "é\U0001f600 5\n" * 30 + "z" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for size, before, after in ((20, 8, 5), (33, 4, 9), (6, 40, 17)):
        got = {r.i: [tuple(p) for p in r.p] for r in df.select("i", spans.pieces(df.t, size, before, after).alias("p")).collect()}
        assert got == {i: [(max(0, a - before), a, b, t[max(0, a - before) : b + after]) for a, b in spans.cut(t, size)] if len(t) > size else [(0, 0, len(t), t)] for i, t in enumerate(texts)}


def test_values_of_long_texts_have_their_places(spark):
    text = "".join(f"{'word ' * (k % 9)}visa {4539148803436467}, {'x' * (k % 130)} ssn one two three four five six seven eight nine\n" if k % 4 else f"{'y' * 70} " for k in range(300))
    want = [m.start() for m in re.finditer("4539148803436467", text)]
    rows = detect(spark.createDataFrame([(1, text)], "k int, text string"), now_year=2026, chunk=200).where("status = 'finding'").collect()
    assert len(text) > 200 * 16 * 3 and sorted(r.start for r in rows if r.cls == "card") == want


@pytest.mark.parametrize("name", ["class_totals", "planted_findings"])
def test_values_of_each_row_count_where_they_come_again(spark, tmp_path, name):
    # keys so far apart plant the same nine digits in the same place
    spark.range(120).selectExpr("id % 60 + 120000 * (id DIV 60) AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    agrees(spark, name, tmp_path)


@pytest.mark.parametrize("name", ["planted_findings"])
def test_values_are_counted_by_hash_tables(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "collect_set" not in plan and "SortAggregate" not in plan and "ArrowEvalPython" not in plan


def test_tar_files_come_in_blocks(spark):
    import io
    import tarfile

    from veilsight import queries_files
    from veilsight.sources import archives

    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        for name, size in (("a", 0), ("d/b", 5000), ("c", 512), ("long" * 60, 70_000)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.addfile(info, io.BytesIO(b"x" * size))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "a"
        f.addfile(link)
    whole = t.getvalue()
    cases = {"whole": whole, "cut": whole[:9000], "other": b"no archive" * 100, "empty": b""}
    blocks = [(p, i, raw[i * 700 : i * 700 + 700]) for p, raw in cases.items() for i in range(max(1, -(-len(raw) // 700)))]
    got = archives.tar_entries(spark.createDataFrame(blocks, "path string, block int, content binary").repartition(3), 60_000).collect()
    for p, raw in cases.items():
        want = [(n, i, c, s) for n, i, c, s in archives.entries_of(raw, None, 60_000)]
        assert sorted(((r.entry, r.entry_index, None if r.content is None else bytes(r.content), r.skipped) for r in got if r.path == p), key=lambda x: x[1]) == want, p
    made = queries_files._tar_blocks(spark, "/root/testdata/sf0.1").selectExpr("length(content) AS n").collect()
    assert len(made) > 200 and max(r.n for r in made) <= archives.BLOCK + 1024
