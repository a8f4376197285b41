"""Learned operators: held-out accuracy, edge cases, equal texts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilsight.llm import language_id, quality_classifier, subword, toxicity, training
from veilsight.llm.arrays import MASK64, RADIX_INV, Laid, mix, utf8
from veilsight.llm.subword import GRAMS, STUTTER
from veilsight.llm.subword import fit as fit_subword
from veilsight.llm.training import fold

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score string, extra int"
EDGE = [(1, None, None, None, "x", 1), (2, "", "en", "a", "x", 2), (3, " \n\t ", "en", "a", "x", 3), (4, "word " * 60_000, "en", "a", "x", 4), (5, "same text here", "en", "a", "x", 5), (5, "same text here", "en", "a", "x", 5), (None, "no id", "de", "b", None, None), (7, "12 34 !!", "fr", "b", "x", 7)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(spark, data, scored, label, folds, out):
    rows = scored.join(data[1], "doc_id").where(fold("doc_id", folds) == out).select("score", label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def test_quality_held_out(spark, data):
    model = quality_classifier.train(*data, keep=fold("doc_id", 4) != 2)
    p, y = held_out(spark, data, quality_classifier.score(data[0].select("doc_id", "text"), model), "quality", 4, 2)
    assert len(y) > 50 and ((p >= 0.7) == (y == 1)).mean() > 0.97


def test_toxicity_held_out(spark, data):
    model = toxicity.train(*data, keep=fold("doc_id", 5) != 0)
    p, y = held_out(spark, data, toxicity.score(data[0].select("doc_id", "text"), model), "toxic", 5, 0)
    assert len(y) > 50 and ((p >= 0.5) == (y == 1)).mean() > 0.97


def test_language_held_out(spark, data):
    model = language_id.train(data[0], keep=fold("doc_id", 4) != 2)
    rows = language_id.predict(data[0], model).where(fold("doc_id", 4) == 2).select("lang", "lang_pred").collect()
    assert np.mean([a == b for a, b in rows]) > 0.97


@pytest.mark.parametrize("which", ["quality", "toxic", "lang"])
def test_edges(spark, data, which):
    rows = spark.createDataFrame(EDGE, SCHEMA)
    if which == "quality":
        out = quality_classifier.score(rows, quality_classifier.train(*data))
    elif which == "toxic":
        out = toxicity.score(rows, toxicity.train(*data))
    else:
        out = language_id.predict(rows, language_id.train(data[0]))
    got = out.collect()
    assert len(got) == len(EDGE) and {"extra", "source", "doc_id"} <= set(out.columns)
    assert all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.text == "same text here"]
    assert same[0] == same[1]
    if which == "lang":
        by = {r.doc_id: r.lang_pred for r in got}
        assert by[1] == by[2] == by[3] == by[7] == "und" and by[4] != "und"
    empty = out.limit(0).select(*rows.columns)
    again = {"quality": lambda: quality_classifier.score(empty, fit_subword(["a", "b"], [0, 1], bits=8)), "toxic": lambda: toxicity.score(empty, toxicity.fit([], [])), "lang": lambda: language_id.predict(empty, fit_subword(["a", "b"], ["x", "y"], bits=8))}[which]()
    assert again.count() == 0 and "score" in again.columns


def test_without_labels(spark, data):
    none = data[1].limit(0)
    docs = spark.createDataFrame(EDGE, SCHEMA)
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.5}
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs.where("lang is null"))).collect()} == {"und"}


def test_filters_keep_columns(spark, data):
    model = toxicity.train(*data)
    kept = toxicity.keep_clean(data[0], model)
    assert kept.columns == data[0].columns and 0 < kept.count() < data[0].count()


def test_score_is_of_the_text_alone():
    texts = ["one two three four", "", "é ü ß", "x" * 5000]
    model = fit_subword(["good words here", "bad ### $$$ text"] * 4, [1, 0] * 4, epochs=2)
    together = model.probabilities(*utf8(pa.array(texts)))
    alone = np.concatenate([model.probabilities(*utf8(pa.array([t]))) for t in texts])
    assert np.array_equal(together, alone)


def test_windows_overlap_and_cover():
    text = " ".join(f"w{i}" for i in range(100))
    read = toxicity.Read(*utf8(pa.array([text, "", "one"])))
    owner, begin, length = read.windows()
    first = begin[owner == 0]
    assert list(np.diff(first)) == [toxicity.STRIDE] * (len(first) - 1) and first[-1] + toxicity.WINDOW >= 100
    for at in range(100 - 17 + 1):  # any 17 words stand whole in one window
        assert any(b <= at and at + 17 <= b + n for b, n in zip(first, length[owner == 0], strict=True))
    assert (owner == 1).sum() == 1 and (owner == 2).sum() == 1


def plain_features(text, bits, lower):
    """Hashed features of a text, gram by gram, hashed one at a time."""
    low = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text)
    padded, out = f" {low} ", []
    space = lambda c: c in " \t\n\x0b\x0c\r"
    one = lambda part: Laid(np.frombuffer(part.encode(), np.uint8), np.array([0, len(part.encode())]))
    for n in GRAMS:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if not any(space(c) for c in gram[1:-1]):
                laid = one(gram)
                h, size = laid.prefix(), len(gram.encode())
                with np.errstate(over="ignore"):
                    key = (h[1 + size] - h[1]) * np.uint64(RADIX_INV)
                    key = (key ^ (key >> np.uint64(29))) * np.uint64((0xBF58476D1CE4E5B9 * (2 * n + 1) & MASK64) | 1)
                out.append(int(key >> np.uint64(64 - bits)))
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", low) if w]
    hashes = [one(w).span_hash(np.array([1]), np.array([1 + len(w.encode())]))[0] for w in words]
    out += [int(h >> np.uint64(64 - bits)) for h in hashes]
    with np.errstate(over="ignore"):
        for a, b in zip(hashes, hashes[1:], strict=False):
            pair = STUTTER if a == b else mix(np.array([a * np.uint64(3) + b]))[0]
            out.append(int(pair >> np.uint64(64 - bits)))
    return out


def test_subword_scores_match_plain_sums():
    model = fit_subword(["good words here and more", "bad bad bad ### text é日本", "third kind of words"] * 5, ["a", "b", "c"] * 5, bits=12, lower=True, epochs=3)
    texts = ["Good words", "bad bad é日本語 ###", "", "x", " tabs\tand\nlines  ", "word word word other"]
    got = model.probabilities(*utf8(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        found = plain_features(t, 12, True)
        logits = np.array([sum(float(model.table[c][f]) for f in found) / max(1, len(found)) for c in range(3)]) + model.bias
        want = np.exp(logits - logits.max())
        assert np.allclose(row, want / want.sum(), atol=1e-6), t


def plain_worst(model, text):
    """The worst window's probability, state by state."""
    read = toxicity.Read(*utf8(pa.array([text])))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h_ = toxicity.HIDDEN

    def logit(b, n):
        x = []
        for k in range(b, b + n):
            rows = np.concatenate([g[c[k] : c[k + 1]] for g, c in zip(read.gram, read.cuts, strict=True)])
            x.append(np.concatenate([model.words[read.word[k]], model.grams[rows].mean(axis=0) if len(rows) else np.zeros(toxicity.CHAR_DIM)]))
        states = []
        for d, cell in enumerate(model.cells):
            h, seen = np.zeros(h_), [None] * n
            for t in range(n) if d == 0 else range(n - 1, -1, -1):
                g, u = x[t] @ cell["w"] + cell["b"], h @ cell["u"]
                z, r = sigmoid(g[:h_] + u[:h_]), sigmoid(g[h_ : 2 * h_] + u[h_ : 2 * h_])
                h = (1 - z) * h + z * np.tanh(g[2 * h_ :] + r * u[2 * h_ :])
                seen[t] = h
            states.append(seen)
        e = np.array([sum(states[d][t] @ model.attend[d] for d in range(2)) for t in range(n)])
        v = np.array([sum(states[d][t] @ model.out[d] for d in range(2)) for t in range(n)])
        a = np.exp(e - e.max(initial=0))
        return (a * v).sum() / a.sum() + model.bias if n else model.bias

    coarse = [(logit(b, n), -b) for _, b, n in zip(*read.windows(), strict=True)]
    at = -max(coarse)[1]
    near = [b for b in range(at - toxicity.STRIDE + toxicity.FINE, at + toxicity.STRIDE, toxicity.FINE) if 0 < b < len(read.word) - toxicity.WINDOW]
    best = max([max(coarse)[0], *(logit(b, toxicity.WINDOW) for b in near)])
    return sigmoid(best * model.scale[0] + model.scale[1])


def test_toxic_scores_match_plain_states():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, n)) + (" vile words" if k % 2 else "") for k, n in enumerate(rng.integers(5, 60, 40))]
    model = toxicity.fit(texts, [k % 2 for k in range(40)], rounds=1, epochs=1)
    model.scale = (0.8, 0.1)
    some = [texts[0], texts[1], "one", "É日本 vile", " ".join(words * 3)]
    got = model.probabilities(*utf8(pa.array(some)))
    assert np.allclose(got, [plain_worst(model, t) for t in some], atol=1e-4)


def test_gradients_match_differences():
    """Back-propagation against differences of the loss."""
    model = toxicity._fresh(3)
    for cell in model.cells:
        for k in cell:
            cell[k] = cell[k].astype(np.float64)
    model.attend, model.out = model.attend.astype(np.float64), model.out.astype(np.float64)
    model.words, model.grams = model.words.astype(np.float64) * 50, model.grams.astype(np.float64) * 20
    read = toxicity.Read(*utf8(pa.array(["a bad word here", "some other words that are fine", "one"])))
    _, begin, length = read.windows()
    y = np.array([1.0, 0.0, 1.0], np.float32)

    class Catch:
        rate, step = 0.0, 0

        def __init__(self):
            self.grads = {}

        def move(self, name, value, grad, rows=None):
            self.grads[name] = (value, grad, rows)

    def loss():
        x = np.concatenate([model.words[read.word], read.mean_rows(model.grams)], axis=1)
        gates = [np.concatenate([x @ c["w"] + c["b"], np.zeros((1, 3 * toxicity.HIDDEN))]) for c in model.cells]
        p = 1 / (1 + np.exp(-model.run(gates, begin, length).astype(np.float64)))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    catch = Catch()
    toxicity._learn(model, read, begin, length, y, catch)
    rng, checked = np.random.default_rng(0), 0
    for name, (value, grad, rows) in catch.grads.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in grad.shape)
            place = (int(rows[at[0]]), *at[1:]) if rows is not None else at
            was, step = value[place], 2e-2
            value[place] = was + step
            up = loss()
            value[place] = was - step
            down = loss()
            value[place] = was
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-3 + 0.05 * abs(grad[at]), (name, at)
            checked += 1
    assert checked == 6 * 12


def test_long_texts_are_read_in_parts(monkeypatch):
    """Parts give what the whole text gives: features, windows, scores and what is learned."""
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "é日本", "x", "  ", "\n", "delta" * 30]
    text = " ".join(rng.choice(words, 4000)) + "  "
    whole = np.bincount(plain_features(text, 12, True), minlength=1 << 12)
    model = toxicity.fit([text, "vile words here"] * 4, [0, 1] * 4, rounds=1, epochs=1)
    data = utf8(pa.array(["one", text, "two vile", text[:50]]))
    want = model.worst(*data)
    sub = fit_subword([text, "bad words"] * 3, [0, 1] * 3, bits=12, epochs=2)
    plain = sub.probabilities(*data)
    monkeypatch.setattr(subword, "RUN_BYTES", 700)
    monkeypatch.setattr(toxicity, "RUN_BYTES", 900)
    assert np.array_equal(subword.counts(np.frombuffer(text.encode(), np.uint8), 12, True), whole)
    got = model.worst(*data)
    # finer steps are taken around each part's worst window, so a part may find a worse one
    assert (got[0] >= want[0] - 1e-6).all() and np.allclose(got[0][[0, 2, 3]], want[0][[0, 2, 3]])
    assert np.allclose(sub.probabilities(*data), plain, atol=1e-6)
    seen = np.concatenate([begin + base for i, base, read in toxicity.reads(*data) if i == 1 for _, begin, _ in [read.windows()]])
    assert list(seen) == list(range(0, 8 * len(seen), 8)) and seen[-1] + toxicity.WINDOW >= len(re.findall(r"\w+", text))
    again = fit_subword([text, "bad words"] * 3, [0, 1] * 3, bits=12, epochs=2)
    assert np.allclose(again.table, sub.table, atol=1e-4)
    toxicity.fit([text, "vile words here"] * 4, [0, 1] * 4, rounds=2, epochs=1)


@pytest.mark.parametrize("place", [0, 3, 11])
def test_one_huge_text_costs_no_other_its_place(spark, place):
    """All of the first rows are learned from, whatever the length of one of them."""
    rows = [(i, "good plain words " * 3 if i % 2 else "bad ### words " * 3) for i in range(12)]
    rows[place] = (place, "long text of words " * 1_600_000)  # 30 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    sample = training.labelled(docs, labels, "quality", F.lit(True), 10)
    seen = training.fitted(sample, 10, lambda texts, y: (len(texts), [len(t) for t in texts], y))
    kept = {r.doc_id for r in labels.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("training"))).limit(10).collect()}
    assert seen[0] == 10 and len(seen[2]) == 10 and (max(seen[1]) > 30_000_000) == (place in kept)


def test_fold_matches_contract(spark):
    import zlib

    ids = [0, 1, 17, 123456789]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(fold("doc_id", 4)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 4 for i in ids]
    assert spark.createDataFrame([(None,)], "doc_id long").select(F.isnull(fold("doc_id", 4))).first()[0] is False
