"""Operators with exact results: brute force, round trips, SQL, edge cases."""

import collections
import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_plain import brute_classes, plain_targets
from veilsight.llm import jaccard_join, mixing, mpeg_audio, packing, quality_rules, queries, token_files, url_filter
from veilsight.llm.arrays import utf8

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
HARD = [None, "", "  ", "a", "a b c d", "A b C d e f", "a  b\tc\n", "é ü 日本 x", "word " * 30_000, "it's 'll we'll\n\nx", "<|endoftext|> a", "a.b, c!\nD e", "   ", "x\x1cy z"]


def texts_frame(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, i) for i, t in enumerate(texts)]
    rows += [(0, texts[5], None, None, 9), (0, texts[5], None, None, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_shingles int")


# ---- 2: token files


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = texts_frame(spark, HARD)
    target = f"file://{tmp_path}/tokens"
    token_files.write(docs, target, TOKENIZER, partitions=3)
    rows = sorted(token_files.read(spark, target).collect(), key=lambda r: r.start)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.digests(spark, target).collect()}
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    tokenizer, start, seen = Tokenizer.from_file(TOKENIZER), 0, collections.Counter()
    want = collections.Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert digests[(r.doc_id, r.start)] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        seen[(r.doc_id, tuple(r.ids))] += 1
        start += r.n_tokens
    assert seen == want


def test_ranks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack_ranks(ranks)
        assert np.array_equal(token_files.unpack_ranks(control, data, n), ranks)
        assert len(control) == -(-n // 4)


def test_token_files_empty(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", TOKENIZER)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0


# ---- 3: packing


def naive(size, source, cluster, capacity, per_source):
    bins = []
    out = []
    for n, s, c in zip(size, source, cluster, strict=True):
        best = None
        for k, b in enumerate(bins):
            if b["room"] >= n and b["s"][s] < per_source and not (c >= 0 and c in b["c"]) and (best is None or (b["room"], k) < (bins[best]["room"], best)):
                best = k
        if best is None:
            bins.append({"room": capacity, "s": collections.Counter(), "c": set()})
            best = len(bins) - 1
        bins[best]["room"] -= n
        bins[best]["s"][s] += 1
        bins[best]["c"] |= {c} if c >= 0 else set()
        out.append(best)
    return out


def test_best_fit_is_tightest():
    rng = random.Random(2)
    for turn in range(80):
        n = rng.randint(0, 80) if turn < 60 else 1500  # several runs of bins
        size = sorted((rng.randint(0, 50) for _ in range(n)), reverse=True)
        source, cluster = [rng.randint(0, 3) for _ in range(n)], [rng.randint(-1, 6) for _ in range(n)]
        assert packing.best_fit(size, source, cluster, 60, 2) == naive(size, source, cluster, 60, 2)


def test_pack(spark):
    rows = [(i, n, f"s{i % 2}", i % 4) for i, n in enumerate([0, 1, 50, 99, 100, 101, 250, 7, 7])] + [(3, 99, "s1", 3)] * 2 + [(None, 5, None, None), (20, 0, None, 1)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long"), capacity=100, per_source=2, shard_words=300).toPandas()
    assert out["size"].sum() == sum(r[1] for r in rows) and len(out) == sum(max(1, -(-r[1] // 100)) for r in rows)
    for _, b in out.groupby("bin"):
        assert b["size"].sum() <= 100 and b.source.fillna("-").value_counts().max() <= 2 and not b.cluster.dropna().duplicated().any()
        by = b.sort_values(["offset", "size"])
        assert by.offset.tolist() == list(np.cumsum([0, *by["size"].tolist()])[:-1])
    assert packing.pack(spark.createDataFrame([], "doc_id long, size long, source string, cluster long")).count() == 0


def test_many_short_texts_of_one_source():
    began = time.process_time()
    for sources in (1, 2):
        n = 50_000
        source = [i % sources for i in range(n)]
        bins = packing.best_fit([20] * n, source, [-1] * n, 4096, 2)
        assert max(collections.Counter(zip(bins, source, strict=True)).values()) == 2 and max(bins) == n // (2 * sources) - 1
    # one cluster that all pieces are of
    assert len(set(packing.best_fit([20] * 20_000, [0] * 20_000, [0] * 20_000, 4096, 500))) == 20_000
    assert time.process_time() - began < 20


def test_few_sources_fill_bins(spark):
    items = spark.range(20_000).select(F.col("id").alias("doc_id"), (20 + F.col("id") % 30).alias("size"), F.lit("one").alias("source"), F.lit(None).cast("long").alias("cluster"))
    assert packing.fill(packing.pack(items)).first().share > 0.9


def test_packing_parts_near_copies(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"]), f"s{i}") for i in range(8)] + [(20 + i, f"alone{i} " * 9, f"s{i}") for i in range(3)]
    rows += [(30, None, "s"), (31, None, "s"), (32, " ", "s"), (33, " ", "t"), (None, "x y z", "s"), (None, "x y z", "t"), (0, rows[0][1], "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = queries.op3_packing(spark, f"file://{tmp_path}").toPandas()
    assert len(out) == len(rows)
    near = out[out.doc_id < 20]
    assert len(near) == 9 and near.bin.nunique() == 9 and (near.cluster == 0).all()
    for few in (out[out.doc_id.isin([32, 33])], out[out.doc_id.isna()]):
        assert few.bin.nunique() == len(few) == 2 and few.cluster.nunique() == 1
    assert out[out.doc_id.isin([30, 31])].cluster.isna().all() and out[out.doc_id.between(20, 29)].cluster.nunique() == 3


# ---- 5: urls


def test_soft_terms_are_weighed():
    found = lambda u: sum(url_filter.DEFAULT_VOCABULARY.soft[t] for t in url_filter.hits(u, url_filter.DEFAULT_VOCABULARY)[1])
    assert found("http://free-free.example.org/win") == 1.0 and found("http://free.example.org/win/cash") == 1.5
    assert found("http://poker.example.org/Bonus") == 1.75 and found("http://pokers.example.org/xbonus") == 0
    assert url_filter.hits("http://a.example.org/xXx", url_filter.DEFAULT_VOCABULARY) == (1, {})


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y", "http://example.net/en", "https://b.example.com/de/1#t", "http://x.org/fr/", "http://x.org/FR/", "http://net", "http://net/", "ftp://casino.example.org/a", "http://casinos.example.org/", "http://cheap-pills.example.org/", "http://cheap.example.org/", "HTTP://XXX.example.org", "http://a?b://c/d"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, None, 1)], "page_id long, url string, host int")
    got = url_filter.judge(pages, queries.RULES)
    rows = sorted(got.select("page_id", "host", "path", "rule", "verdict").collect(), key=lambda r: r.page_id)
    by = {r.page_id: r for r in rows}
    assert by[3].host == "a.example.net" and by[3].rule == "example.net/en/" and by[3].verdict == "allow"
    assert by[4].rule == "net/" and by[4].verdict == "block" and by[5].rule == "example.com/de/" and by[6].rule == "org/fr/" and by[7].rule is None
    assert by[8].rule is None and by[9].rule == "net/" and by[10].verdict == "block" and by[11].verdict == "allow" and by[12].verdict == "block" and by[13].verdict == "allow"
    assert by[0].verdict == "allow" and (by[0].host, by[0].path) == ("", "")
    db = duckdb.connect()
    table = pages.select("page_id", "url").toPandas()
    db.register("pages", table)
    want = db.execute(url_filter.oracle(queries.RULES)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    assert url_filter.judge(pages.limit(0)).count() == 0


# ---- 6: rules


def plain_counts(text):
    words = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_counts_are_exact():
    rng = random.Random(4)
    texts = [t or "" for t in HARD] + ["".join(rng.choice(["a ", "b ", "c\n", "#", "\n", "é "]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    found = quality_rules.counts(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        assert tuple(int(c[i]) for c in found[:5]) == plain_counts(t), t[:80]


def test_outliers(spark):
    rng = random.Random(1)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(80)), "en", "s") for i in range(150)]
    bad = [(1000 + i, " ".join("#$%" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(80)), "en", "s") for i in range(8)]
    edge = [(2000, None, None, None), (2001, "", "en", None), (2002, "word", None, "s")]
    docs = spark.createDataFrame(clean + bad + edge, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(1))
    counted = quality_rules.statistics(docs)
    out = {r.doc_id: r for r in quality_rules.judge(counted).collect()}
    assert len(out) == docs.count()
    assert all(out[i].kept for i, *_ in clean) and not any(out[i].kept for i, *_ in bad)
    assert all(out[i].base_failed and not out[i].kept for i in (2000, 2001, 2002))
    assert quality_rules.judge(quality_rules.statistics(docs.limit(0))).count() == 0


def plain_verdicts(rows):
    """distance and verdict of (id, lang, source, counts), by loops over groups in numpy."""
    q = quality_rules

    def vector(c):
        n, chars, symbols, dup, repeat, lines = c
        w, ln = max(n, 1), max(lines, 1)
        return [np.log((chars + 8) / (w + 1)), np.arcsinh(20 * symbols / (w + 20)), np.arcsinh(2 * dup / (ln + 4)), np.arcsinh(2 * repeat / (w + 20))]

    x = np.array([vector(r[3]) for r in rows])
    keys = [(r[1], r[2]) for r in rows]
    groups = {k: np.array([i for i, o in enumerate(keys) if o == k]) for k in set(keys)}
    langs = {k: np.array([i for i, o in enumerate(keys) if o[0] == k]) for k in {k[0] for k in keys}}

    def edge(values, share):
        v = np.sort(values)
        return v[int(np.ceil(share * len(v) - 1e-9)) - 1]

    def medians(off):
        half = lambda rows_, j: (edge(np.floor(off[rows_, j] / q.WIDTH), 0.5) + 0.5) * q.WIDTH
        out = {}
        for k, rows_ in groups.items():
            in_lang = langs[k[0]]
            out[k] = []
            for j in range(4):
                wide = (len(in_lang) * half(in_lang, j) + q.PRIOR * half(np.arange(len(off)), j)) / (len(in_lang) + q.PRIOR)
                out[k].append((len(rows_) * half(rows_, j) + q.PRIOR * wide) / (len(rows_) + q.PRIOR))
        return {k: np.array(v) for k, v in out.items()}

    m = medians(x)
    a = medians(np.abs(x - np.array([m[k] for k in keys])))
    e = {k: (m[k], np.diag(1 / ((1.4826 * a[k]) ** 2 + q.FLOOR**2)), np.inf) for k in groups}
    bins = lambda: np.array([np.floor(np.log((x[i] - e[k][0]) @ e[k][1] @ (x[i] - e[k][0]) + 1e-3) * q.FINE) for i, k in enumerate(keys)])
    tri = np.tril_indices(4)
    moments = lambda i: np.array([len(i), *x[i].sum(axis=0), *(x[i][:, tri[0]] * x[i][:, tri[1]]).sum(axis=0)])
    while True:
        b = bins()
        own = {k: moments(i[b[i] <= edge(b[i], q.SUPPORT)]) for k, i in groups.items()}
        every = sum(own.values())
        new = {}
        for k in groups:
            lang = sum(v for o, v in own.items() if o[0] == k[0])
            wide = lang + q.PRIOR * every / every[0]
            t = own[k] + q.PRIOR * wide / wide[0]
            mean, inv, logdet = q.solve(t[0], t[1:5], t[5:])
            new[k] = (mean, inv, round(logdet, 6))
        falls = {k for k in groups if new[k][2] < e[k][2] - q.MOVES}
        e = {k: new[k] if k in falls else e[k] for k in groups}
        if not falls:
            break
    b = bins()
    out = {}
    for k, i in groups.items():
        scale = max(1.0, (len(i) * np.exp((edge(b[i], 0.5) + 0.5) / q.FINE) / q.chi2_quantile(0.5) + q.PRIOR) / (len(i) + q.PRIOR))
        for j in i:
            d = (x[j] - e[k][0]) @ e[k][1] @ (x[j] - e[k][0]) / scale
            n, repeat = rows[j][3][0], rows[j][3][4]
            out[rows[j][0]] = (d, not (n < 20 or 100 * repeat > 30 * n) and d <= q.chi2_quantile(q.ALONE))
    return out


def test_verdicts_match_plain_estimates(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        n = rng.randint(15, 300)
        odd = rng.random() < 0.08
        rows.append((i, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), (n, n * rng.randint(4, 6), rng.randint(0, 3) + odd * n, rng.randint(0, 1) + odd * 5, rng.choice([0, 0, 0, 8]), rng.randint(1, 12))))
    rows += [(400, "fr", "z", (100, 500, 0, 0, 0, 5)), (401, "fr", "z", (100, 500, 0, 0, 0, 5)), (402, None, None, (0, 0, 0, 0, 0, 0))]  # repeated rows of a group of two
    counted = spark.createDataFrame(rows, f"doc_id long, lang string, source string, stats {quality_rules.KIND}").withColumn("distance", F.lit("x"))
    got = {r.doc_id: (r.distance, r.kept) for r in quality_rules.judge(counted).collect()}
    again = {r.doc_id: (r.distance, r.kept) for r in quality_rules.judge(counted.repartition(7)).collect()}
    want = plain_verdicts(rows)
    assert got == again and got.keys() == want.keys()
    assert all(abs(got[i][0] - want[i][0]) <= 1e-3 * max(1, want[i][0]) and got[i][1] == want[i][1] for i in want)
    assert got[400] == got[401] and 0 < sum(not k for _, k in got.values()) < 200


def test_repeated_lines_are_outliers(spark):
    rows = [(i, "en", "s", (80, 400, 0, 0, 0, 9)) for i in range(150)] + [(150, "en", "s", (80, 400, 0, 6, 0, 9))]
    counted = spark.createDataFrame(rows, f"doc_id long, lang string, source string, stats {quality_rules.KIND}")
    out = {r.doc_id: r for r in quality_rules.judge(counted).collect()}
    assert not out[150].base_failed and [i for i, r in out.items() if not r.kept] == [150]


# ---- 7: audio


def test_audio_round_trip(spark):
    docs = texts_frame(spark, HARD).withColumn("audio", F.lit(1))
    out = mpeg_audio.with_features(docs.withColumn("media", mpeg_audio.to_media("text"))).collect()
    for r in out:
        raw = mpeg_audio.padded((r.text or "").encode())
        assert r.audio.payload_bytes == len(raw) and len(raw) % 64 == 0 and raw
        assert r.audio.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.audio.tail_crc32 == zlib.crc32(raw[-64:])
    assert len({r.audio.feature for r in out if r.text == HARD[5]}) == 1


def test_audio_parser():
    raw = bytes(random.Random(1).randbytes(20_000))
    media = mpeg_audio.encode(mpeg_audio.padded(raw))
    s = mpeg_audio.parse(media)
    assert s.bad == s.resyncs == s.skipped == 0 and s.table["frames"] == len(s.audio) and s.duration * 44100 == 1152 * len(s.audio)
    assert s.seek(0) == s.offsets[1] and s.seek(s.samples - 1) == s.offsets[-1]
    cut = mpeg_audio.parse(media[:5000] + b"\xff\xfbnoise\x00" * 9 + media[5000:] + b"TAG" + bytes(125))
    assert cut.resyncs >= 1 and "TAG" in cut.tags and len(cut.audio) >= len(s.audio) - 1
    damaged = bytearray(media)
    damaged[s.offsets[3] + 10] ^= 255
    assert mpeg_audio.parse(bytes(damaged)).bad == 1
    for junk in (b"", None, b"\xff" * 500, b"ID3", bytes(999)):
        assert mpeg_audio.parse(junk).samples == 0
    with pytest.raises(ValueError):
        mpeg_audio.decode(b"")


def test_audio_payload_like_a_tag():
    for n in (64, 128, 192, 1344, 1408):  # 1408: over one whole frame
        for back in range(3, min(n, 300) + 1):
            raw = b"a" * (n - back) + b"TAG" + b"b" * (back - 3)
            media = mpeg_audio.encode(raw)
            s = mpeg_audio.parse(media)
            assert mpeg_audio.decode(media, s) == raw and s.skipped == s.resyncs == 0, (n, back)


def test_audio_checksums_of_all_layers():
    rng = random.Random(5)

    def plain_crc(bits):
        c = 0xFFFF
        for bit in bits:
            top = c >> 15 ^ bit
            c = c << 1 & 0xFFFF ^ (0x8005 if top else 0)
        return c

    as_bits = lambda raw: [b >> k & 1 for b in raw for k in range(7, -1, -1)]
    #: layer II, MPEG 1, stereo at 192 kbit/s: 4 bits in 11 subbands, 3 in 12, 2 in 7, for two channels
    for layer, index, mode, nbal in ((2, 10, 0, [4] * 11 + [3] * 12 + [2] * 7), (1, 10, 0, [4] * 32), (1, 10, 0x50, [4] * 32)):
        word = 0xFFE00000 | 3 << 19 | (4 - layer) << 17 | index << 12 | mode
        h = mpeg_audio.header(word)
        body = bytes(rng.randbytes(h.length - 6))
        bits, used, more = as_bits(body), 0, 0
        shared = 8 if mode else 32  # mode extension 1: subbands 8 and up are shared
        for sb, n in enumerate(nbal):
            for _ in range(2 if sb < shared else 1):
                more += 2 * any(bits[used : used + n])
                used += n
        covered = used + (more if layer == 2 else 0)
        crc = plain_crc(as_bits(word.to_bytes(4, "big")[2:]) + bits[:covered])
        frame = word.to_bytes(4, "big") + crc.to_bytes(2, "big") + body
        good, bad = mpeg_audio.parse(frame * 3), mpeg_audio.parse(frame[:6] + bytes([body[0] ^ 128]) + frame[7:])
        assert (good.checked, good.bad, len(good.audio)) == (3, 0, 3) and (bad.checked, bad.bad) == (1, 1), (layer, mode)


def test_audio_duration_and_offsets(spark):
    texts = [None, "", "TAG" * 60, "ID3 Xing VBRI " * 200, "x" * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("media", mpeg_audio.to_media("text"))
    for r in mpeg_audio.with_features(docs).collect():
        assert r.audio.error is None and r.audio.payload_bytes == len(mpeg_audio.padded((r.text or "").encode()))
        assert len(r.audio.offsets) == r.audio.frames and all(r.media[o] == 255 and r.media[o + 1] >> 5 == 7 for o in r.audio.offsets)
        assert Fraction(r.audio.duration) == Fraction(1152 * r.audio.frames, 44100)
    assert mpeg_audio.with_features(docs.limit(0)).count() == 0
    # two rates in one stream
    low, high = (0xFFE00000 | 3 << 19 | 1 << 17 | 1 << 16 | 9 << 12 | r << 10 for r in (2, 0))
    frames = [w.to_bytes(4, "big") + bytes(mpeg_audio.header(w).length - 4) for w in (low, high)]
    s = mpeg_audio.parse(frames[0] * 2 + frames[1] * 3)
    assert s.duration == Fraction(2 * 1152, 32000) + Fraction(3 * 1152, 44100)
    # damage: the payload is missing, the row isn't
    media = bytearray(mpeg_audio.encode(b"y" * 640))
    media[-400] ^= 1
    broken = spark.createDataFrame([(bytes(media), 1), (None, 2)], "media binary, audio int")
    rows = mpeg_audio.with_features(broken).collect()
    assert rows[0].audio.payload_sha256 is None and rows[0].audio.error == "payload damaged" and rows[1].audio.frames == 0


# ---- 8: near duplicates


@pytest.mark.parametrize("blocks", [400_000, 2000, 300])
def test_classes_match_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", blocks)
    rng = random.Random(8)
    texts = list(HARD[:8])
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(4, 60))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 99)}"
            texts.append(" ".join(w))
            if rng.random() < 0.3:
                texts.append(" ".join(w).upper())
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(1, texts[5]), (None, texts[9])]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_shingles int")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(docs).collect())
    assert got == brute_classes(rows)


def test_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (2, "A b c d e f g", 2), (2, "A b c d e f g", 2), (3, None, 3), (4, "", 4), (5, "other words", 5), (5, "other words", 5)], "doc_id long, text string, key int")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert jaccard_join.classes(docs.limit(0)).count() == 0


def test_a_common_shingle_is_counted_in_runs():
    # two runs: in the first two sets share shingle 5, in the second a set has it too
    n = 4
    sets = [{1: [5, 7, 9], 2: [5, 8]}, {3: [5, 6], 1: [5, 7, 9]}]
    rows = []
    for run in sets:
        made = jaccard_join._Run(n)
        for key, items in run.items():
            made.add(np.array([key], np.uint64), np.array([len(items)]), np.array(items, np.uint64) << np.uint64(40))
        rows += [b for batch in made.flush() for b in batch.to_pylist()]
    entries = [x for r in rows for x in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["items"], np.uint32).tolist(), strict=True)]
    # 5, 7, 9, 8 in the first run, 5, 6, 7, 9 in the second; 5 is marked in both
    assert len(entries) == 8 and sum(k == 0 for k, _ in entries) == 2
    said = collections.Counter()
    for r in rows:
        for key, (shared, size) in zip(np.frombuffer(r["sets"], np.uint64).tolist(), np.frombuffer(r["sizes"], np.uint32).reshape(-1, 2).tolist(), strict=True):
            said[key, shared, size] += 1
    assert said == {(1, 1, 3): 2, (2, 1, 2): 1, (3, 1, 2): 1}


# ---- 9: mixing


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 400):
        size, p = rng.integers(0, 500, n), rng.uniform(0, 1, n)
        q = mixing.flight(p, size, 5)
        assert abs((q - p).sum()) < 1e-6 and abs(((q - p) * size).sum()) < 1e-4
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2 and q.min() > -1e-9 and q.max() < 1 + 1e-9


@pytest.mark.parametrize("sizes", [{"b": 100, None: 100, "a": 100}, {"a": 1, "b": 10**6, "é": 3, "Z": 500, None: 7}, {"x": 5}, {"x": 0, "y": 0}, {f"s{i}": (i * 7919) % 1000 for i in range(60)}])
def test_targets_match_plain_sharing(spark, sizes):
    units = spark.createDataFrame([(i, s, n, 1) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long, n long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(units).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s][0] == sizes[s] and abs(got[s][1] - float(want[s])) <= 1e-9 * max(1, sizes[s]) for s in want)


def test_many_alike_documents_are_numbered_in_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 5)
    docs = spark.createDataFrame([(None, f"w{i} x", "s") for i in range(40)] + [(1, "a b", "t")], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("text").count().collect()
    uses = {r.doc_id: (r.n, r.whole, r.extra) for r in mixing.uses(docs.select("doc_id", "source", mixing.n_words("text").alias("size"))).collect()}
    n, whole, extra = uses[None]
    many = collections.Counter(r["count"] for r in got if r.text.startswith("w"))
    assert many == +collections.Counter({whole + 1: extra, whole: n - extra if whole else 0})


@pytest.mark.parametrize("group", [2000, 20])
def test_mix_near_targets(spark, group):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", mixing.n_words("text").alias("size"))
    docs = docs.union(spark.createDataFrame([(None, None, 0), (1, None, 10), (1, None, 10)], "doc_id long, source string, size long"))
    first = mixing.taken(docs, group=group).toPandas()
    again = mixing.taken(docs.repartition(3), group=group).toPandas()
    key = ["source", "doc_id", "size", "taken"]
    assert first.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert len(first) == docs.count() and (first.taken <= 2 * first["size"]).all()
    by = first.groupby(first.source.fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    assert mixing.taken(docs.limit(0)).count() == 0


def test_mix_copies_rows(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 3 else None, 1) for i in range(30)] + [(1, "a b c", "s", 1)], "doc_id long, text string, source string, uses int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    n = out.groupBy("doc_id", "source").count().collect()
    assert max(r["count"] for r in n) <= 4 and abs(out.count() * 3 - 1.5 * 93) <= 12
