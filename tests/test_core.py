"""Discovery operators on inline rows, and the SQL of every query at the smallest scale."""

import math
import os

import duckdb
import random

import pytest
from pyspark.sql import functions as F

from veilsight import queries
from veilsight.functions import text as T
from veilsight.functions import validators as V
from veilsight.operators import conversation, coverage, export, findings, incremental
from veilsight.operators.detect import detect
from veilsight.plans import scan
from veilsight.sources import files, json_leaves, tables, tagged
from veilsight.streaming import logs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return repr(round(v, 6)) if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float | bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_sql_agrees(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    assert rows == sorted([plain(v) for v in r] for r in want.fetchall())


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_validators_of_odd_input(spark):
    odd = [None, "", "abc", "١٢٣", "12a", "4111 1111"]
    for f in (V.luhn_valid, V.ssn_valid, V.itin_valid, V.is_test_card, lambda c: V.date_digits(c, 2026), lambda c: V.date_token(c, 2026)):
        assert values(spark, f, odd) == [False] * len(odd)
    assert values(spark, V.card_brand, ["6761000000000000", "2720990000000000", "30000000000000", "411111111111111"]) == ["maestro", "mastercard", "diners", None]
    assert values(spark, lambda c: V.date_token(c, 2026), ["2024-02-30", "2024-02-29", "2/29/23", "12/31/99", "13/1/1999", "1899-01-01"]) == [False, True, False, True, False, False]
    assert values(spark, V.grouping, ["4539148803436467", "4539 1488 0343 6467", "4539-1488 0343-6467", "3 7 8 2", "3782-822463-10005", "45 39"]) == ["plain", "printed", "odd", "spaced_digits", "printed", "odd"]
    assert values(spark, V.card_head, ["4539 1488 0343 6467 04", "4539148803436467", "1234 5678 9012 3456"]) == ["4539 1488 0343 6467", "4539148803436467", None]


def test_shapes(spark):
    for cls, d, want in (("card", "6759649826438453", "full"), ("card", "0000000000000000", "soft"), ("us_ssn", "219099998", "full"), ("cvv", "12", "none"), ("pin", "1234", "full"), ("dob", "013185", "full")):
        assert values(spark, lambda c, k=cls: V.shape(k, c, 2026), [d]) == [want], (cls, d)


def test_text_helpers(spark):
    assert values(spark, T.humanize, ["cardNumber", "card_number"]) == ["card Number", "card number"]
    assert values(spark, T.pointer_escape, ["a/b~c"]) == ["a~1b~0c"]
    assert values(spark, T.is_label, ["Date of birth", "a b c d e", "x 1234", None]) == [True, False, False, False]
    assert values(spark, lambda c: T.utf16_index(c, F.lit(2)), ["😀ab"]) == [3]
    assert values(spark, T.redact, ["a 219-09-9998 b 4539148803436467 c 12345678901234567890 d 12"]) == ["a ###-##-#### b ################ c #################### d 12"]
    assert values(spark, T.digits_of_speech, ["four five uh three nine", "double five oh 1", "1980-01-01, 5 6", "123#"]) == ["4539", "5501", "1980-01-01, 56", "123"]
    assert values(spark, T.redaction_markers, ["[PII] and [SSN] [nope] [REDACTED:x y]"]) == [3]

    def bucket(key):
        h = 0x811C9DC5
        raw = key.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return h % 100

    keys = ["", "a", "path/to/file.txt", "é", "😀", "ü/日本"]
    assert values(spark, T.sample_point, keys) == [bucket(k) for k in keys] and values(spark, T.sample_point, [None]) == [None]


def test_spans_are_code_points(spark):
    row = spark.createDataFrame([("😀 12 \x01 345",)], "x string").select(T.spans(F.col("x"), "[0-9]+")).first()[0]
    assert [(s.raw, s.start, s.end) for s in row] == [("12", 2, 4), ("345", 7, 10)]


TEXTS = [
    (0, "card 4539 1488 0343 6467 04/29 ok"),
    (1, "order 4539148803436467 then 219-09-9998, 123-45-6789"),
    (2, "my ssn is 219099998 and itin 912-70-1234; 4111111111111111"),
    (3, "date of birth 03/14/1985, charged on 09/03/2026"),
    (4, "born March 3rd, 1990; DOB 1991-02-03 10:22"),
    (5, ""),
    (6, "x1234567890123456 219099998"),
    (7, None),
]


def test_detect(spark):
    docs = spark.createDataFrame([(i, t, "old") for i, t in TEXTS], "id int, text string, status string")
    rows = [tuple(r) for r in detect(docs).select("id", "cls", "start", "end", "via", "confidence", "status").orderBy("id", "start").collect()]
    assert rows == [
        (0, "card", 5, 24, "context", "high", "finding"),
        (1, "card", 6, 22, "shape", "medium", "suppressed"),
        (1, "us_ssn", 28, 39, "shape", "medium", "finding"),
        (1, "us_ssn", 41, 52, "shape", "medium", "test"),
        (2, "us_ssn", 10, 19, "context", "high", "finding"),
        (2, "us_itin", 29, 40, "context", "high", "finding"),
        (2, "card", 42, 58, "shape", "medium", "test"),
        (3, "dob", 14, 24, "context", "high", "finding"),
        (4, "dob", 5, 20, "context", "high", "finding"),
    ]
    assert "text" not in detect(docs).columns


def test_no_value_in_results(spark):
    docs = spark.createDataFrame(TEXTS, "id int, text string")
    out = scan.documents(docs, "id").toPandas().to_csv() + findings.status_counts(detect(docs), ["id"]).toPandas().to_csv()
    assert not any(v in out for v in ("4539148803436467", "219099998", "219-09-9998", "912701234", "0343"))


def test_summary_counts_values(spark):
    rows = [(1, "card", s, s + 5, "shape", "medium", "finding", k) for s, k in enumerate(["a", "a", "b", None, None])] + [(1, "card", 9, 12, "context", "high", "finding", "a"), (1, "dob", 1, 2, "context", "high", "test", None)]
    found = spark.createDataFrame(rows, "id int, cls string, start int, end int, via string, confidence string, status string, value_key string")
    r = findings.summarize(found, ["id"], offsets=True).collect()
    assert len(r) == 1 and (r[0]["count"], r[0].occurrences, r[0].confidence, r[0].n_high, r[0].via, r[0].severity) == (4, 6, "high", 1, ["context", "shape"], "high")
    assert len(r[0].offsets) == 6 and not r[0].offsets_truncated


def test_links_and_replacement(spark):
    f = spark.createDataFrame([("a", "s1", "x", "card"), ("b", "s2", "x", "card"), ("c", "s2", "x", "dob"), ("d", "s3", "x", "card")], "id string, source string, place string, cls string")
    linked = {r.id: r.linked for r in findings.link(f, ["place"]).collect()}
    assert linked["a"] == ["b", "d"] and linked["c"] == [] and linked["b"] == ["a", "d"]
    old = spark.createDataFrame([("x", "card", 1, 5), ("y", "card", 1, 7)], "place string, cls string, first_seen int, count int")
    new = spark.createDataFrame([("x", "card", 9, 6), ("x", "dob", 9, 1)], "place string, cls string, first_seen int, count int")
    got = findings.replace(old, new, new.select("place"), ["place", "cls"])
    assert sorted(tuple(r) for r in got.select("place", "cls", "first_seen", "count").collect()) == [("x", "card", 1, 6), ("x", "dob", 9, 1), ("y", "card", 1, 7)]


def test_scores(spark):
    truth = spark.createDataFrame([(1, "card", 2), (2, "card", 1)], "doc int, cls string, n int")
    found = spark.createDataFrame([(1, "card", 3)], "doc int, cls string, n int")
    r = findings.score(truth, found, ["doc"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and abs(r.f1 - 2 / 3) < 1e-9


def test_prompts(spark):
    said = ["What is your social security number?", "last four of your social security number", "Sorry, I didn't get that! Your PIN?", "hello", "card number and security code"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string").withColumn("h", conversation.prompt_hits(F.col("t")))
    got = [r[0] for r in rows.orderBy("i").select(conversation.prompt_classes(F.col("h"))).collect()]
    assert got == [["us_ssn", "us_itin"], ["us_ssn_last4"], ["pin"], [], ["card", "cvv"]]


def test_conversation_parts(spark):
    talk = [
        ("a", 0, "agent", "Your card number?", "speech", 0, 1), ("a", 1, "customer", "4539 1488", "speech", 1000, 2000), ("a", 2, "agent", "mm-hmm", "speech", 2100, 2200),
        ("a", 3, "customer", "0343 6467", "speech", 3000, 4000), ("b", 0, "agent", "Your card number?", "speech", 0, 1), ("b", 1, "customer", "4539 1488", "speech", 1000, 2000),
        ("b", 2, "customer", "0343 6467", "speech", 60_000, 61_000),
    ]
    turns = spark.createDataFrame(talk, "conv_id string, turn int, speaker string, text string, channel string, begin_ms long, end_ms long")
    got = sorted(conversation.classify(turns).collect(), key=lambda r: (r.conv_id, r.turn))
    assert (got[0].conv_id, got[0].turn, got[0].end_turn, got[0].cls, got[0].via, got[0].confidence) == ("a", 1, 3, "card", "prompt", "high")
    assert [tuple(p) for p in got[0].parts] == [(1, 0, 8, 0, 9), (3, 0, 8, 0, 9)]
    # the other halves were a minute apart
    assert [(r.turn, r.end_turn, r.confidence) for r in got[1:]] == [(1, 1, "low")]


def test_running_totals(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.k: r.total_v for r in incremental.running_total(rows, "k", ["v"]).collect()}
    total = 0
    for k in range(1000):
        total += k % 7
        assert got[k] == total
    taken = incremental.admit(rows.withColumn("v", F.lit(10)), "k", "v", 50, 333)
    assert taken.count() == 33 and incremental.admit(rows.withColumn("v", F.lit(999)), "k", "v", 50, 333).count() == 1
    assert incremental.admit(rows.limit(0), "k", "v", 5, 5).count() == 0


def test_duplicates_and_copies(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", None), ("e", "y")], "key string, content string")
    rows = incremental.duplicates(items, F.col("content"), "key")
    assert {r.key: r.duplicate_of for r in rows.collect()} == {"a": None, "b": "a", "c": None, "d": None, "e": None}
    found = spark.createDataFrame([("a", "card", 2)], "key string, cls string, count int")
    assert [tuple(r) for r in incremental.copy_findings(found, rows, "key").select("key", "cls", "count", "duplicate_of").collect()] == [("b", "card", 2, "a")]


def test_rules(spark):
    stores = spark.createDataFrame([("s3", "logs-prod"), ("s3", "tmp"), ("db", "tmp")], "kind string, name string")
    got = [(r.kind, r.name) for r in incremental.allowed(stores, allow=[("s3", "logs*")], deny=[("db", "t?p")]).where("allowed").collect()]
    assert got == [("s3", "logs-prod")]


def test_coverage(spark):
    runs = spark.createDataFrame([("a", 1, 5, {"x": 1}, "old"), ("a", 2, 7, {"x": 2, "y": 1}, "new")], "src string, seq int, read int, skipped map<string,bigint>, note string")
    assert tuple(coverage.merge(runs, ["src"], ["read"], ["note"]).first()) == ("a", 12, "new")
    assert coverage.merge_maps("skipped", ["src"], runs).first().skipped == {"x": 3, "y": 1}
    rows = spark.createDataFrame([("hot", 1000, 1 << 30)], "class string, objects long, planned long")
    prices = spark.createDataFrame([("hot", "r1", 0.5, 0.25)], "class string, region string, per_gib double, per_1000 double")
    r = coverage.cost(rows, prices, "class", F.lit("r2"), "r1").first()
    assert r.cost == 0.75 and r.fallback


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a/b": {"c": [1, "x", null, true]}, "d": 2.5}'), (2, "no json"), (3, None), (4, '"top"')], "id int, j string")
    got = sorted((r.id, r.pointer, r.name, r.text) for r in json_leaves.leaves(df, ["id"], "j").where("pointer <> ''").collect())
    assert got == [(1, "/a~1b/c/0", "c", "1"), (1, "/a~1b/c/1", "c", "x"), (1, "/d", "d", "2.5")]  # neither nulls nor booleans
    deep = spark.createDataFrame([(1, "[" * 40 + "7" + "]" * 40), (2, "[1, 2, 3]")], "id int, j string")
    assert {r.id: (len(r.json.leaves), r.json.left_out) for r in json_leaves.opened(deep, ["id"], "j", max_leaves=2).collect()} == {1: (0, 1), 2: (2, 1)}


def test_table_units_and_plan(spark):
    df = spark.sql("SELECT 1 AS k, '219-09-9998' AS ssn, 4539148803436467 AS pan, 1.5D AS amount, true AS flag, date'1985-03-14' AS date_of_birth, date'1985-03-14' AS hire_date")
    cells = {r.column: r.text for r in tables.cells(df, ["k"]).collect()}
    assert set(cells) == {"ssn", "pan", "date_of_birth", "hire_date"} and cells["pan"] == "4539148803436467"
    found = {(r.column, r.cls, r.confidence) for r in scan.table(df, ["k"]).collect()}
    assert found == {("ssn", "us_ssn", "high"), ("pan", "card", "medium"), ("date_of_birth", "dob", "high")}


def test_neighbouring_cells(spark):
    rows = [(0, "ssn of 12"), (1, "219109998"), (2, "x" * 80 + " 1"), (3, "219109997"), (4, "y" * 40 + " 2"), (5, "ssn 3"), (None, "219109996"), (6, "4539 1488"), (7, "0343 6467"), (7, "0343 6467"), (8, ""), (9, None), (500, "219109995")]
    df = spark.createDataFrame(rows, "r int, code string").withColumn("f", F.lit(None).cast("string"))
    got = scan.table_places(df, ["f"], "r")
    # row 3's is 82 characters behind the first word and 42 before the second; row 500 is in another block, or else 36 behind the second
    assert [(r.r, r.pointer, r.cls, r.start, r.end, r.status) for r in got.collect()] == [(1, "/1/code", "us_ssn", 0, 9, "finding")]
    wide = scan.table_places(df, ["f"], "r", batch=1000).select("r").collect()
    assert sorted(r.r for r in wide) == [1, 500] and scan.table_places(df.limit(0), ["f"], "r").count() == 0
    many = spark.range(1300).select(F.lit("f").alias("f"), F.col("id").alias("r"), F.format_string("ssn 21910%04d", F.col("id") + 1).alias("code"))
    assert {(r.r, r.start) for r in scan.table_places(many, ["f"], "r", classes=["us_ssn"]).collect()} == {(k, 4) for k in range(1300)}


def test_coverage_tells_what_is_left_out(spark):
    df = spark.createDataFrame([(1, "a" * 12, "[1, [2, [3, 4]]]"), (2, "7", None)], "k int, t string, j string")
    assert {(r.column, r.cells, r.candidates, r.cut, r.chars) for r in scan.table_coverage(df.select("k", "t"), ["k"], most=10).collect()} == {("t", 2, 1, 1, 11)}
    read = lambda **how: {(r.k, r.leaves, r.left_out) for r in scan.json_coverage(df, ["k"], "j", **how).collect()}
    assert read(max_depth=2) == {(1, 2, 1), (2, 0, 0)} and read(max_depth=100, max_leaves=1 << 30) == {(1, 4, 0), (2, 0, 0)}


def test_rules_over_tags(spark):
    stores = spark.createDataFrame([("s3", "a", {"scan": "false"}), ("s3", "b", {"team": "data-x"}), ("s3", "c", {}), ("s3", "d", None), ("db", "e", None)], "kind string, name string, tags map<string,string>")
    names = lambda **how: sorted(r.name for r in incremental.allowed(stores, **how).where("allowed").collect())
    assert names(deny=[("s3", "scan", "false")]) == ["b", "c", "e"] and names(deny=[("*", "team", None)]) == ["a", "c"]
    assert names(allow=[("s3", "team", "data*")]) == ["b", "e"] and names(allow=[("s3", "team", None), ("s3", "c")], deny=[("s3", "b*")]) == ["c", "e"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("card 4539148803436467")
    (tmp_path / "b.txt").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.bin").write_bytes(bytes(range(256)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.units(spark.read.format("binaryFile").load(str(tmp_path)), max_bytes=1000).collect()}
    assert rows["a.txt"].kind == "text" and rows["a.txt"].skipped is None and rows["b.txt"].disguised and rows["b.txt"].skipped == "kind_pdf"
    assert rows["c.bin"].kind == "binary"


def test_log_stream(spark, tmp_path):
    lines = [("2026-01-01 00:00:10", "g1", 'prefix {"pan": "4539148803436467"}'), ("2026-01-01 00:00:20", "g1", "nothing"), ("2026-01-02 05:00:00", "g1", "card 4539148803436467"), ("2026-01-05 00:00:00", "g2", "x")]
    source = spark.createDataFrame(lines, "ts string, grp string, message string").select(F.to_timestamp("ts").alias("ts"), "grp", "message")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    query = logs.counts(stream, ["grp"]).writeStream.format("memory").queryName("log_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((str(r.window.start), r.cls, r.occurrences) for r in spark.table("log_counts").collect()) == [("2026-01-01 00:00:00", "card", 1), ("2026-01-02 00:00:00", "card", 1)]


def test_changes(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", 1, False), (1, "y", 2, False), (2, "b", 1, True), (3, "n", 1, False)], "k int, v string, seq int, deleted boolean")
    assert sorted(tuple(r) for r in logs.apply_changes(now, changes, ["k"], "seq").collect()) == [(1, "y"), (3, "n")]


def test_transcripts(spark):
    import json

    from veilsight.sources import transcripts

    call = {"Participants": [{"ParticipantId": "p1", "ParticipantRole": "AGENT"}], "Transcript": [{"Content": "Your PIN?", "ParticipantId": "p1", "BeginOffsetMillis": 0, "EndOffsetMillis": 900}, {"Content": "1234", "ParticipantId": "p2", "BeginOffsetMillis": 1000, "EndOffsetMillis": 1500}]}
    chat = {"Transcript": [{"Content": "joined", "Type": "EVENT"}, {"Content": "hi", "Type": "MESSAGE", "ParticipantRole": "CUSTOMER", "AbsoluteTime": "2026-01-01T00:00:01Z"}]}
    docs = spark.createDataFrame([("a", json.dumps(call)), ("b", json.dumps(chat)), ("c", "no json"), ("d", None)], "conv_id string, doc string")
    rows = [(r.conv_id, r.turn, r.speaker, r.channel, r.begin_ms, r.pointer) for r in transcripts.contact_turns(docs).orderBy("conv_id", "turn").collect()]
    assert rows == [("a", 0, "agent", "speech", 0, "/Transcript/0/Content"), ("a", 1, "customer", "speech", 1000, "/Transcript/1/Content"), ("b", 1, "customer", "chat", 1767225601000, "/Transcript/1/Content")]
    assert [(r.conv_id, r.cls, r.confidence) for r in conversation.classify(transcripts.contact_turns(docs)).collect()] == [("a", "pin", "high")]
    lex = [json.dumps({"sessionId": "s", "timestamp": t, "inputMode": "Text", "inputTranscript": x, "messages": [{"content": m}]}) for t, x, m in (("2026-01-01T00:00:09Z", "1234", "thanks"), ("2026-01-01T00:00:01Z", "hello", "your pin please"))]
    turns = transcripts.bot_turns(spark.createDataFrame(list(enumerate(lex)), "n int, doc string")).orderBy("turn").collect()
    assert [(t.speaker, t.text) for t in turns] == [("customer", "hello"), ("bot", "your pin please"), ("customer", "1234"), ("bot", "thanks")]
    flow = json.dumps({"ContactFlowModuleType": "GetUserInput", "ContactId": "x", "Parameters": {"Text": "Enter your PIN"}, "Results": "1234"})
    assert [(t.speaker, t.channel, t.text) for t in transcripts.flow_turns(spark.createDataFrame([("x", flow), ("y", "{}")], "conv_id string, doc string")).orderBy("turn").collect()] == [("bot", "speech", "Enter your PIN"), ("customer", "dtmf", "1234")]
    leaves = spark.createDataFrame([("l", 0, "p1?"), ("l", 1, "11"), ("l", 2, "p2?"), ("l", 3, "22"), ("m", 0, "33")], "list_id string, ord int, text string")
    pairs = transcripts.answers(leaves, F.col("text").endswith("?"), F.col("text").rlike("^[0-9]+$"))
    assert {r.text: r.prompt for r in pairs.collect()} == {"11": "p1?", "22": "p2?", "33": None}


def test_archives(spark):
    import gzip
    import io
    import tarfile
    import zipfile

    from veilsight.sources import archives

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "one")
        f.writestr("d/b.txt", "two")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        info = tarfile.TarInfo("c.txt")
        info.size = 5
        f.addfile(info, io.BytesIO(b"three"))
    rows = [("z", z.getvalue()), ("t", t.getvalue()), ("g", gzip.compress(b"four")), ("tg", gzip.compress(t.getvalue())), ("n", b"plain"), ("e", None), ("bad", b"PK\x03\x04broken")]
    files_ = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    got = sorted((r.path, r.entry, None if r.content is None else bytes(r.content), r.skipped) for r in archives.entries(files_).collect())
    assert got == [("bad", "", None, "unreadable"), ("g", "", b"four", None), ("t", "c.txt", b"three", None), ("tg", "c.txt", b"three", None), ("z", "a.txt", b"one", None), ("z", "d/b.txt", b"two", None)]
    assert {r.skipped for r in archives.entries(files_.where("path = 'z'"), max_entries=1).collect()} == {None, "entries"}


def test_avro_of_odd_files(spark):
    from veilsight import queries_files
    from veilsight.sources import avro

    good = queries_files._avro(spark.createDataFrame([("a", "x\ny\nz\nu")], "path string, text string")).first().content
    files_ = spark.createDataFrame([("good", good), ("cut", good[:-20]), ("text", bytearray(b"plain")), ("none", None), ("empty", bytearray())], "path string, content binary")
    got = {}
    for r in avro.rows(files_).collect():
        got.setdefault(r.path, []).append((r.row, r.error))
    assert got["good"] == [(k, None) for k in range(4)] and got["cut"][:2] == [(0, None), (1, None)] and got["cut"][-1][1]
    assert all(len(got[k]) == 1 and got[k][0][1] for k in ("text", "none", "empty"))


def test_cells_of_odd_texts(spark):
    from veilsight.sources import delimited

    odd = [(1, None), (2, ""), (3, "a,b"), (4, 'a,b\n"x ""1"", y",2\r\n,"open'), (5, "h\n1,2")]
    rows = delimited.cells(spark.createDataFrame(odd, "id int, text string"), ["id"]).collect()
    said = sorted((r.id, r.row, r.at, str(r.column), r.text) for r in rows if r.row)
    assert said == [(4, 1, 0, "a", 'x ""1"", y'), (4, 1, 1, "b", "2"), (4, 2, 1, "b", "open"), (5, 1, 0, "h", "1"), (5, 1, 1, "None", "2")]
    assert all(dict(odd)[r.id][r.start : r.end] == r.text for r in rows)


def test_what_is_cut_is_told(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (2, "y")], "k int, t string")
    assert {r.k: (len(r.text), r.cut) for r in tables.cells(df, ["k"]).collect()} == {1: (4096, True), 2: (1, False)}
    raw = spark.createDataFrame([(bytearray(b"number 12345678 " * 8),)], "b binary")
    r = raw.select(files.printable_runs(F.col("b"), 100).alias("t"), files.printable_left_out(F.col("b"), 100).alias("n")).first()
    assert len(r.t) == 100 and r.n == 28


def test_csv(spark, tmp_path):
    from veilsight.operators import export

    row = {c: "x" for c in export.CSV_COLUMNS} | {"finding_id": "0" * 32, "severity": "low", "count": 1, "occurrences": 2, "store": "=cmd()", "location": "card 4539148803436467", "console_link": "https://a.example/b"}
    frame = spark.createDataFrame([row, row | {"finding_id": "1" * 32, "severity": "high", "console_link": "javascript:1"}])
    rows = export.csv_rows(frame).collect()
    assert [r.severity for r in rows] == ["high", "low"] and rows[0].store == "'=cmd()" and rows[0].location == "card ################" and [r.console_link for r in rows] == ["", "https://a.example/b"]
    export.write_csv(frame, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(export.CSV_COLUMNS)
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate((60, 40, 1, 250, 60, 30, 10, 1))], "id int, n long")
    assert [r.part for r in export.parts(sizes, "id", "n", 100).orderBy("id").collect()] == [0, 0, 1, 2, 3, 3, 3, 4]
    assert [r.part for r in export.parts(sizes.limit(3), "id", "n", 100, fixed=50).orderBy("id").collect()] == [0, 1, 1] and export.parts(sizes.limit(0), "id", "n").count() == 0


def test_spoken_values_have_their_piece_as_context(spark):
    """A context word 340,000 characters before is none, as long texts are cut before anything is looked at."""
    said = "five two three, four five, six seven eight nine"
    far = "my ssn\n" + "plain words go on and on\n" * 13_600 + said + "\n"
    near = "plain words go on and on\n" * 13_600 + "my ssn is " + said + "\n"
    rows = detect(spark.createDataFrame([(1, far), (2, near)], "k int, text string"), now_year=2025).collect()
    assert [(r.k, r.cls, r.via, r.status) for r in rows] == [(2, "us_ssn", "context", "finding")]
    assert near[rows[0].start : rows[0].end].startswith("five two") and rows[0].end <= len(near)


def test_detection_is_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "card 4242 4242 4242 4242")], "k int, text string").write.parquet(str(tmp_path / "t"))
    df = detect(spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan and "Union" not in plan


@pytest.mark.parametrize("block", [3, 64])
def test_parts_as_one_walk(spark, block):
    """Blocks of any size give what filling one part after the other gives."""
    rng = random.Random(block)
    for sizes in ([rng.choice([0, 1, 5, 40, 99, 100, 101, 250]) for _ in range(40)], [None, -3, 0, 0, 100]):
        df = spark.createDataFrame([(i * 2, n) for i, n in enumerate(sizes)], "id long, n int").repartition(3)
        want, part, used, some = [], 0, 10, False
        for n in (max(0, x or 0) for x in sizes):
            if some and used + n > 100:
                part, used = part + 1, 10
            used, some = used + n, True
            want.append(part)
        assert [r.part for r in export.parts(df, "id", "n", 100, 10, block).orderBy("id").collect()] == want


def test_vendor_reports(spark):
    import json

    from veilsight.sources import vendor

    doc = {"classificationDetails": {"result": {"sensitiveData": [{"detections": [{"type": "CREDIT_CARD_NUMBER", "count": 2}, {"type": "CREDIT_CARD_MAGNETIC_STRIPE", "count": 3}, {"type": "NAME", "count": 1}]}], "customDataIdentifiers": {"detections": [{"name": "CREDIT_CARD_NUMBER", "count": -4}]}}}}
    rows = vendor.findings(spark.createDataFrame([("a", json.dumps(doc)), ("b", "{}"), ("c", None)], "location string, doc string")).collect()
    assert sorted((r.location, r.cls, r.vendor_type, r["count"]) for r in rows if r.vendor_type) == [("a", "other", "NAME", 1), ("a", "other", "custom:CREDIT_CARD_NUMBER", 0)]
    assert [(r.cls, r["count"], r.severity) for r in rows if not r.vendor_type] == [("card", 5, "high")]


def test_raw_and_office(spark):
    import io
    import zipfile

    from veilsight.sources import archives

    raw = b"\x00\x01card 4539148803436467\x00\xffno digits here\x02" + "wide 12345".encode("utf-16-le") + b"\x00\x01ab1"
    got = spark.createDataFrame([(bytearray(raw),), (None,)], "c binary").select(files.printable_runs(F.col("c"))).collect()
    assert got[0][0] == "card 4539148803436467\nwide 12345" and got[1][0] in (None, "")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:body><w:p><w:t>SSN &amp; more</w:t></w:p><w:p><w:t>219-09-9998</w:t></w:p></w:body>")
        f.writestr("word/styles.xml", "<x>skip</x>")
    doc = spark.createDataFrame([("a.docx", bytearray(z.getvalue()))], "path string, content binary")
    text = files.office_text(archives.entries(doc))
    assert text.first().text == "SSN & more\n219-09-9998\n"
    assert [(r.cls, r.confidence) for r in detect(text).collect()] == [("us_ssn", "high")]


def test_rescans_and_tables(spark):
    stale = spark.range(100).select("id", F.lit(10).alias("n"))
    assert incremental.rescans(stale, "id", "n", 40, 10_000).count() == 10 and incremental.rescans(stale, "id", "n", 400, 200).count() == 5
    assert incremental.rescans(stale, "id", "n", 40, 10_000, percent=0).count() == 0
    listing = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "key string, marker string")
    index = spark.sql("SELECT * FROM VALUES ('a', '1', date'2026-01-08'), ('b', '0', date'2026-01-08'), ('c', null, date'2026-01-08'), ('d', '1', date'2026-01-01') AS t(key, marker, read_at)")
    got = incremental.table_changes(listing, index, F.lit("2026-01-09").cast("date"))
    assert {r.key for r in got.where("decision = 'skip'").collect()} == {"a"}
    rows = spark.createDataFrame([("x", "f", 8), ("y", "f", 0), ("z", "f", 4), ("w", "g", 16)], "key string, fingerprint string, flags int")
    assert [tuple(r) for r in incremental.by_fingerprint(rows).collect()] == [("f", "y")]


def test_tagged_values(spark):
    item = '{"a/b": {"S": "x"}, "n": {"N": "5"}, "z": {"S": ""}, "o": {"BOOL": true}, "u": {"NULL": true}, "m": {"M": {"l": {"L": [{"M": {"k": {"S": "q"}, "d": {"N": 7}}}, {"S": "s"}]}}}, "s": {"NS": ["1", "2"]}, "bad": 3}'
    df = spark.createDataFrame([(1, item), (2, None), (3, "no json"), (4, "[1]"), (5, ""), (6, "{}")], "id int, doc string")
    got = tagged.leaves(df, ["id"], "doc").orderBy("id", "ord").collect()
    assert [(r.id, r.pointer, r.path, r.name, r.text, r.list_id, r.position) for r in got] == [
        (1, "/a~1b", "a/b", "a/b", "x", None, None),
        (1, "/n", "n", "n", "5", None, None),
        (1, "/z", "z", "z", "", None, None),
        (1, "/m/l/0/k", "m.l[].k", "k", "q", "/m/l", 0),
        (1, "/m/l/0/d", "m.l[].d", "d", "7", "/m/l", 0),
        (1, "/m/l/1", "m.l[]", "l", "s", "/m/l", 1),
        (1, "/s/0", "s[]", "s", "1", "/s", 0),
        (1, "/s/1", "s[]", "s", "2", "/s", 1),
    ]
    assert got[3].fields == {"k": "q", "d": "7"}
    deep = '{"a": ' + '{"M": {"b": ' * 40 + '{"S": "x"}' + "}}" * 40 + "}"
    assert tagged.leaves(spark.createDataFrame([(1, deep)], "id int, doc string"), ["id"], "doc").count() == 0
    assert tagged.leaves(df.limit(0), ["id"], "doc").count() == 0


@pytest.mark.parametrize("path, pointers", [("m", ["/m/l/0/k", "/m/l/1/k"]), ("m.l[].k", ["/m/l/0/k", "/m/l/1/k"]), ("m.l[k=q].k", ["/m/l/0/k"]), ("m.l[k=q, k=r]", []), ("m.l.k", []), ("m.l[].k.x", [])])
def test_attribute_paths(spark, path, pointers):
    df = spark.createDataFrame([('{"m": {"M": {"l": {"L": [{"M": {"k": {"S": "q"}}}, {"M": {"k": {"S": "r"}}}]}}}}',)], "doc string")
    rows = tagged.leaves(df, [], "doc")
    assert [r.pointer for r in rows.where(tagged.covers(path, F.col("steps"))).orderBy("ord").collect()] == pointers


@pytest.mark.parametrize("path", ["", "[]", ".a", "a..b", "a.", "a[b", "a]b", "a[b]", "a[=c]"])
def test_bad_attribute_paths(spark, path):
    with pytest.raises(ValueError):
        tagged.covers(path, F.col("steps"))


def test_stale_without_records(spark):
    schema = "scheme string, adapter string, adapter_v string, readers map<string,string>, unread array<string>, sniffer_v string, detected string, standalone_v string, classes map<string,string>, conversation_v string, flags int"
    now = {"scheme": "2", "sniffer": "1", "standalone": "1", "conversation": "1"}
    rows = [
        ("2", "gone", "0", None, None, "1", "text", "1", None, "1", 0),
        ("1", "store", "0", None, None, "1", "text", "1", None, "1", 0),
        ("2", "store", None, None, None, "1", "text", "1", None, "1", 0),
        ("2", "store", "1", {"rtf": "1"}, None, "1", "text", "1", None, "1", 0),
        ("2", "store", "1", None, None, "0", "text", "1", None, "1", 1),
        ("2", "store", "1", None, None, "1", "text", "1", None, "1", 4),
        ("2", "store", "1", None, None, "1", "text", "1", {"card": "1"}, None, 7),
    ]
    got = incremental.stale_reason(spark.createDataFrame(rows, schema).coalesce(1), now, {"store": "1"}, {"text": "1"}, {"card": "1"})
    assert [r.stale for r in got.collect()] == [None, None, "adapter", "reader", "sniffer", "standalone", "conversation"]


def test_grants_refuse_unknown(spark):
    df = spark.createDataFrame([("a", "SELECT"), ("b", None), ("c", " insert"), ("c", "select"), ("c", "INSERT")], "principal string, privilege string")
    assert sorted(map(tuple, incremental.write_grants(df, ["select"]).collect())) == [("b", ["UNKNOWN"]), ("c", ["INSERT"])]


def test_gaps_of_nothing(spark):
    df = spark.createDataFrame([(None, 0), ({"large": 2}, None)], "skipped map<string,int>, partial int")
    assert [tuple(r) for r in coverage.gaps(df, ["skipped"], ["partial"]).collect()] == [("skipped", "large", 2)]
    assert coverage.gaps(df.limit(0), ["skipped"], ["partial"]).count() == 0


def test_findings_document(spark):
    import json

    df = spark.createDataFrame([("b", "low", 1), ("a", "high", 2)], "id string, severity string, count int")
    got = json.loads(export.document(findings.top(df), {"schema": "1"}).first()[0])
    assert got == {"schema": "1", "findings": [{"id": "a", "severity": "high", "count": 2}, {"id": "b", "severity": "low", "count": 1}]}
    assert json.loads(export.document(findings.top(df.limit(0)), {"schema": "1"}).first()[0]) == {"schema": "1", "findings": []}


def test_html_report(spark, tmp_path):
    rows = spark.createDataFrame([("<b>", 2, None), ("4111111111111111", 1, "a&'\"")], "store string, count int, note string")
    export.write_html("Report <1>", [("Stores", rows.repartition(3), ["count"]), ("None", rows.limit(0), ["count"])], str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r"), wholetext=True).collect()]
    assert len(lines) == 1
    got = lines[0].splitlines()
    assert got[0].endswith("<title>Report &lt;1&gt;</title><h1>Report &lt;1&gt;</h1>")
    assert got[1] == "<h2>Stores</h2><table><tr><th>store</th><th>count</th><th>note</th></tr>"
    assert "4111111111111111" not in got[2] and got[2].endswith("<td>1</td><td>a&amp;&#x27;&quot;</td></tr>")
    assert got[3:] == ["<tr><td>&lt;b&gt;</td><td>2</td><td></td></tr>", "</table>", "<h2>None</h2><table><tr><th>store</th><th>count</th><th>note</th></tr>", "</table>", "</html>"]
