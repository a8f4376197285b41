"""Operators on vectors against plain versions: codes, exact top-k, whitening."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilsight.llm import exact_topk, vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, score string, x string, n int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, lab, "s", "x", 1) for i, v, lab in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def mixed(spark):
    """A hot vector with a third of the rows, ties, repeated rows and ids, nulls, odd lengths and values."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 8).astype(np.float32)], i % 4) for i in range(120)]
    rows += [(200 + i, [0.25, -0.5, 0.0, 0.125, 0.0, 0.0, 1.0, -1.0], None) for i in range(60)]
    rows += [(7, rows[7][1], 3), (40, rows[40][1], 0), (None, rows[5][1], 1), (300, [0.5, 0.5], 1), (301, [], 2), (302, [0.0] * 8, None)]
    bad = [(400, None, 1), (420, [0.1, None] + [0.0] * 6, 1), (440, [NAN] * 8, 1), (460, [INF] + [0.0] * 7, 1), (480, [-INF] + [0.0] * 7, None)]
    return rows, table(spark, rows + bad)


def floors(rows, scale, dim=None):
    dim = dim or max(len(r) for _, r, _ in rows)
    return [[math.floor(scale * v) for v in r] + [0] * (dim - len(r)) for _, r, _ in rows]



def plain_codes(rows, parts=4, entries=16, rounds=4):
    x = floors(rows, 1024)
    w = len(x[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, np.array([math.floor(1024 * v) for v in rows[i][1]], "<i4").tobytes()))
    books = [[x[i][p * w : (p + 1) * w] for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        codes = [[min((far(v[p * w : (p + 1) * w], c), k) for k, c in enumerate(books[p])) for p in range(parts)] for v in x]
        if turn == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * w : (p + 1) * w] for v, c in zip(x, codes, strict=True) if c[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    error = [sum(d for d, _ in c) for c in codes]
    by = {}
    for (_, _, lab), e in zip(rows, error, strict=True):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{k:02x}" for _, k in c), e, by[r[2]], sha) for r, c, e in zip(rows, codes, error, strict=True))


def test_codes_match_a_full_search(mixed):
    rows, df = mixed
    got = vector_codes.compress(df, entries=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain_codes(rows)


def test_exponion_search_reads_less_and_finds_the_same():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (40, 3))
    entries = np.concatenate([centres, centres[:5], centres[3:4]])  # equal entries: the lower index wins
    book = vector_codes.Book(entries)
    x = np.concatenate([centres[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 3)), rng.integers(-6000, 6000, (500, 3)), (centres[:10] + centres[10:20]) // 2])
    for factor in (1, 20_000):  # doubles, then whole numbers
        big = vector_codes.Book(entries * factor) if factor > 1 else book
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        near, least, _ = big.nearest(x * factor, rng.integers(0, len(entries), len(x)))
        assert np.array_equal(near, d.argmin(1)) and np.array_equal(least, d.min(1) * factor * factor)
    _, _, taken = book.nearest(x[:3000], ((x[:3000, None] - entries[None]) ** 2).sum(2).argmin(1))
    assert taken < 3000 * len(entries) * 0.6


def plain_top(rows, every, k):
    x, out = floors(rows, 64), []
    for q, (i, _, _) in enumerate(rows):
        if i is not None and i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x[q], x[c], strict=True)), j is None, j or 0) for c, (j, _, _) in enumerate(rows) if c != q)[:k]
            out += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("every", "k", "block"), [(20, 20, 1 << 18), (5, 3, 400), (20, 500, 1 << 18)])
def test_top_k_matches_sorting(mixed, monkeypatch, every, k, block):
    """With ties far beyond k, blocks of a few rows, and k above the number of rows."""
    rows, df = mixed
    monkeypatch.setattr(exact_topk, "BLOCK_BYTES", block)
    got = exact_topk.search(df, every=every, k=k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_top(rows, every, k)


def test_large_components_are_exact(spark):
    rows = [(i, [float(1 << 20) * (i + 1), -3.0 * i, 0.015625 * i], 0) for i in range(12)]
    got = exact_topk.search(table(spark, rows), every=4, k=5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((q, r, j, s) for q, r, j, s in plain_top([(i, v, 0) for i, v, _ in rows], 4, 5)), key=str)
    assert exact_topk.widths(5184) == [41, 1] and exact_topk.widths(0) == [1]


def plain_white(rows):
    x = np.array(floors(rows, 256), object)
    fit = sorted({tuple(r) for r in x.tolist()})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array(fit, float) - np.array(s, float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    w = (x.astype(float) - np.array(s, float) / n) @ v / np.sqrt(e)
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x.tolist()]
    return n, dev, w, e / e.sum()


def test_whitening_matches_eigenvectors(mixed, monkeypatch):
    rows, df = mixed
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    n, dev, w, share = plain_white(rows)
    got = whitening.whiten(df.repartition(7)).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    key = lambda i: (i is None, i or 0)
    for j in range(4):
        mine = sorted(((key(r.vec_id), r.deviation, r.whitened) for r in got if r.component == j + 1), key=lambda t: (t[0], t[1]))
        want = sorted(((key(i), d, float(v)) for (i, _, _), d, v in zip(rows, dev, w[:, j], strict=True)), key=lambda t: (t[0], t[1]))
        assert [m[:2] for m in mine] == [t[:2] for t in want]
        a, b = (np.array([t[2] for t in x]) for x in (mine, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert all(abs(r.explained - share[j]) < 1e-9 for r in got if r.component == j + 1)


def test_whitening_edges(spark):
    flat = table(spark, [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0), (3, [0.5], 1)])  # one distinct vector and a shorter one
    got = {(r.vec_id, r.component): r for r in whitening.whiten(flat).collect()}
    assert len(got) == 6 and got[1, 1].whitened is not None and got[1, 2].whitened is None and got[1, 2].explained < 1e-12 and got[1, 1].n == 2
    one = whitening.whiten(flat.where("vec_id < 3")).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in one} == {(None, None, None, 0, 1)}
    huge = whitening.whiten(table(spark, [(1, [3e30, 1.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert any(r.deviation is None for r in huge) and all(np.isfinite(r.whitened) for r in huge if r.whitened is not None)


@pytest.mark.parametrize("rows", [[], [(1, None, 0), (20, [NAN], 1)], [(20, [0.5, 1.0], 1)], [(20, [], 1), (40, [], None)]])
def test_empty_and_tiny_tables(spark, rows):
    df = table(spark, rows) if rows else table(spark, [(1, [1.0], 0)]).limit(0)
    good = [r for r in rows if r[1] is not None and not any(v is None or v != v for v in r[1])]
    codes = vector_codes.compress(df).collect()
    assert len(codes) == len(good) and all(r.error == 0 for r in codes)
    assert exact_topk.search(df).count() == (2 if len(good) == 2 else 0)
    assert whitening.whiten(df).count() == sum(min(4, len(r[1])) for r in good)


def test_usable_vectors(spark, mixed):
    rows, df = mixed
    assert df.where(vectors.usable("embedding")).count() == len(rows)
    assert spark.range(1).select(vectors.floors(F.array(F.lit(-0.1), F.lit(0.0), F.lit(0.99)), 64)).first()[0] == [-7, 0, 63]
