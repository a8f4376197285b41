"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text's words are its runs of letters and digits (ASCII letters lower-cased; bytes of
other scripts count as letters).  A word's input is a learned row for the hashed word,
beside the mean of learned rows for its character 3-grams and 4-grams, ends included.
Overlapping windows of ``WINDOW`` words, one each ``STRIDE`` words until the text ends (so any
17 words in a row stand whole in one) and one each ``FINE`` words around the worst of these, run through a forward and a backward gated recurrent layer; attention weights pool the states,
and a logistic output scores the window.  A document's score is that of its worst window.

Training is numpy in one task, over a bounded sample of labelled documents.  A label
speaks of a document, so the windows that teach are chosen: from a toxic document those with
the words most typical of toxic documents in the sample, then again those that the network itself
finds worst; from a clean one its worst by either, and others at random.

The network is learned twice on half of ``CALIBRATE_ROWS`` documents, to calibrate on what each half hasn't seen, and
then on all of the sample.  All of the sample's texts are learned from whole, long ones in parts that overlap by a window.

Edge cases: a null or empty text, or one without words, scores as an empty window;
null labels and labels other than 0 and 1 teach nothing; equal texts score equally; without
labels of both kinds every score is that kind's (0.5 without any); all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .arrays import LOWER, Laid, char_grams, runs, utf8
from .training import crossed, fitted, labelled

#: Most labelled documents that the network is trained on.
TRAIN_ROWS = 4000
#: The first of these, from whose halves the calibration comes.
CALIBRATE_ROWS = 1500
THRESHOLD = 0.5

WINDOW, STRIDE, FINE = 24, 8, 2
HIDDEN = 8
WORD_DIM, CHAR_DIM = 8, 8
WORD_BITS, CHAR_BITS = 15, 16
#: Lengths of the character n-grams, word ends included.
GRAMS = (3, 4, 5)
RUN_BYTES = 1 << 19
BATCH = 1024
#: Training steps of each round at least, however few the documents.
LEAST_STEPS = 150
#: Share of a toxic window's other words that are swapped for clean ones in each step.
SWAP = 0.95
#: Clean windows drawn for each round, beside every clean document's worst (two a document, if that is more).
SPARE = 8000

#: What words are made of, after lower-casing; all other bytes count as spaces.
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
FOLD = np.where(LETTER, np.arange(256), 0x20).astype(np.uint8)[LOWER]


@dataclass
class ToxicModel:
    words: np.ndarray  # hashed word -> row
    grams: np.ndarray  # hashed n-gram -> row
    cells: list[dict[str, np.ndarray]]  # forward, backward
    attend: np.ndarray  # both directions' states -> attention weight's logit
    out: np.ndarray  # the same -> output
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)  # logit -> calibrated logit
    constant: float | None = None
    trained: dict = field(default_factory=dict)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.worst(data, offsets)[0]

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text its score and the first word of its worst window."""
        n = len(offsets) - 1
        if self.constant is not None:
            return np.full(n, self.constant), np.zeros(n, np.int64)
        out, where = np.full(n, -np.inf), np.zeros(n, np.int64)
        for i, base, read in reads(data, offsets):
            x = self.inputs(read)
            owner, begin, length = read.windows()
            logits = self.all(x, begin, length)
            best = read.best(owner, logits)
            # finer steps around each text's worst window
            steps = np.array([d for d in range(FINE - STRIDE, STRIDE, FINE) if d])
            near = begin[best][:, None] + steps
            first, last = read.first[:-1, None], np.maximum(read.first[:-1], read.first[1:] - WINDOW)[:, None]
            text, k = np.nonzero((near > first) & (near < last))
            fine = self.all(x, near[text, k], np.full(len(text), WINDOW))
            owner, begin, logits = np.append(owner, text), np.append(begin, near[text, k]), np.append(logits, fine)
            order = np.lexsort((begin, owner))
            owner, begin, logits = owner[order], begin[order], logits[order]
            best = read.best(owner, logits)
            better = np.flatnonzero(logits[best] > out[i : i + read.n])
            out[i + better], where[i + better] = logits[best[better]], base + begin[best[better]] - read.first[better]
        z = np.clip(out * self.scale[0] + self.scale[1], -40, 40)
        return 1 / (1 + np.exp(-z)), where

    def all(self, x: list[np.ndarray], begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logits of windows, some at a time."""
        return np.concatenate([self.run(x, begin[k : k + BATCH], length[k : k + BATCH]) for k in range(0, len(begin), BATCH)] or [np.zeros(0, np.float32)])

    def inputs(self, read: Read) -> list[np.ndarray]:
        """Every word's share in both directions' gates; one row of zeros more, for padding."""
        x = np.concatenate([self.words[read.word], read.mean_rows(self.grams)], axis=1)
        return [np.concatenate([x @ c["w"] + c["b"], np.zeros((1, 3 * HIDDEN), np.float32)]) for c in self.cells]

    def run(self, x: list[np.ndarray], begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        steps = int(length.max(initial=1))
        att = np.zeros((len(begin), steps), np.float32)
        val = np.zeros((len(begin), steps), np.float32)
        short = int(length.min(initial=steps)) < steps
        for d, cell in enumerate(self.cells):
            h = np.zeros((len(begin), HIDDEN), np.float32)
            both = np.stack([self.attend[d], self.out[d]], axis=1)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                inside = t < length if short else None
                row = begin + t if inside is None else np.where(inside, begin + t, len(x[d]) - 1)
                g = x[d].take(row, axis=0)
                u = h @ cell["u"]
                g[:, : 2 * HIDDEN] += u[:, : 2 * HIDDEN]
                gates = np.tanh(0.5 * g[:, : 2 * HIDDEN])
                gates *= 0.5
                gates += 0.5
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                new -= h
                new *= z
                h = h + new
                if inside is not None:
                    h *= inside[:, None]
                e = h @ both
                att[:, t] += e[:, 0]
                val[:, t] += e[:, 1]
        if short:
            att[np.arange(steps) >= length[:, None]] = -1e9
        att -= att.max(axis=1, keepdims=True)
        np.exp(att, out=att)
        return (att * val).sum(axis=1) / att.sum(axis=1) + self.bias


class Read:
    """A run of texts as hashed words and n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        laid = Laid(FOLD[data], offsets)
        self.n = laid.n
        space = laid.buf == 0x20
        starts, ends = laid.bounds(~space)
        self.first = laid.first_of(starts)
        self.word = (laid.span_hash(starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.intp)
        found = [char_grams(laid, space, k, CHAR_BITS) for k in GRAMS]
        # an n-gram belongs to the word with its second character
        self.gram = [bucket for _, _, bucket in found]
        self.cuts = [np.append(np.searchsorted(second, starts), len(second)) for _, second, _ in found]

    def mean_rows(self, table: np.ndarray) -> np.ndarray:
        total = np.zeros((len(self.word), table.shape[1]), np.float32)
        count = np.zeros(len(self.word), np.float32)
        for gram, cuts in zip(self.gram, self.cuts, strict=True):
            size = np.diff(cuts)
            full = np.flatnonzero(size)
            if len(full):
                total[full] += np.add.reduceat(table.take(gram, axis=0), cuts[:-1][full], axis=0)
                count[full] += size[full]
        return total / np.maximum(count, 1)[:, None]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner text, first word and number of words of every window; a text has one at least."""
        words = np.diff(self.first)
        many = 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE))
        owner = np.repeat(np.arange(self.n), many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        begin = self.first[owner] + step * STRIDE
        return owner, begin, np.minimum(WINDOW, self.first[owner + 1] - begin)

    def best(self, owner: np.ndarray, logits: np.ndarray) -> np.ndarray:
        """The first of each text's highest windows; ``owner`` is sorted and has every text."""
        first = np.searchsorted(owner, np.arange(self.n))
        top = np.maximum.reduceat(logits, first)
        high = np.flatnonzero(logits == np.repeat(top, np.diff(np.append(first, len(owner)))))
        return high[np.unique(owner[high], return_index=True)[1]]


def reads(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Read]]:
    """The texts in short runs: the first one's number, the run's first word and the run.  A text over ``RUN_BYTES`` comes
    in parts that share a window's words, so that its windows are the same."""
    for i, j in runs(offsets, RUN_BYTES):
        text = data[offsets[i] : offsets[j]]
        if len(text) <= RUN_BYTES:
            yield i, 0, Read(text, offsets[i : j + 1] - offsets[i])
            continue
        letter = LETTER[LOWER[text]]
        starts = np.flatnonzero(letter & ~np.append(False, letter[:-1]))
        at = 0
        while True:  # a part starts at a multiple of the stride
            limit = (starts[at] if at < len(starts) else 0) + RUN_BYTES
            stop = max(at + STRIDE, at + (int(np.searchsorted(starts, limit)) - at) // STRIDE * STRIDE)
            end = stop + WINDOW - STRIDE
            begin = 0 if at == 0 else starts[at]
            part = text[begin : starts[end] if end < len(starts) else len(text)]
            yield i, at, Read(part, np.array([0, len(part)]))
            if end >= len(starts):
                break
            at = stop


def _fresh(seed: int) -> ToxicModel:
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    cells = [{"w": f(WORD_DIM + CHAR_DIM, 3 * HIDDEN, s=0.4), "u": f(HIDDEN, 3 * HIDDEN, s=0.3), "b": np.zeros(3 * HIDDEN, np.float32)} for _ in range(2)]
    return ToxicModel(f(1 << WORD_BITS, WORD_DIM, s=0.005), f(1 << CHAR_BITS, CHAR_DIM, s=0.02), cells, f(2, HIDDEN, s=0.3), f(2, HIDDEN, s=0.5))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.kept = rate, 0, {}

    def move(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        """With ``rows``, only these rows of a table have a gradient and only they move."""
        m, v = self.kept.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        k = slice(None) if rows is None else rows
        m[k] = 0.9 * m[k] + 0.1 * grad
        v[k] = 0.99 * v[k] + 0.01 * grad * grad
        fix = np.sqrt(1 - 0.99 ** min(self.step, 2000)) / (1 - 0.9 ** min(self.step, 2000))
        value[k] -= self.rate * fix * m[k] / (np.sqrt(v[k]) + 1e-6)


def _learn(model: ToxicModel, read: Picked, begin: np.ndarray, length: np.ndarray, y: np.ndarray, adam: _Adam, swap: np.ndarray | None = None) -> float:
    """One step of back-propagation through time over a batch of windows.

    ``swap`` has, for each word of each window, the word that stands in for it."""
    n, steps, h_ = len(begin), int(length.max(initial=1)), HIDDEN
    at = np.minimum(begin[:, None] + np.arange(steps), max(0, len(read.word) - 1)) if swap is None else swap
    inside = (np.arange(steps) < length[:, None]).astype(np.float32)
    flat = at.ravel()
    used, back = np.unique(flat, return_inverse=True)
    word_rows = read.word[used]
    means, shares = [], []
    total, count = np.zeros((len(used), CHAR_DIM), np.float32), np.zeros(len(used), np.float32)
    for gram, cuts in zip(read.gram, read.cuts, strict=True):
        size = cuts[used + 1] - cuts[used]
        owner = np.repeat(np.arange(len(used)), size)
        pos = np.repeat(cuts[used], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        np.add.at(total, owner, model.grams[gram[pos]])
        count += size
        means.append(owner)
        shares.append(gram[pos])
    count = np.maximum(count, 1)
    x = np.concatenate([model.words[word_rows], total / count[:, None]], axis=1)[back].reshape(n, steps, -1)
    x = x * inside[:, :, None]
    hs, caches = [], []
    for d, cell in enumerate(model.cells):
        h = np.zeros((n, h_), np.float32)
        out, cache = np.zeros((n, steps, h_), np.float32), [None] * steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g = x[:, t] @ cell["w"] + cell["b"]
            u = h @ cell["u"]
            zr = 1 / (1 + np.exp(-(g[:, : 2 * h_] + u[:, : 2 * h_])))
            z, r = zr[:, :h_], zr[:, h_:]
            c = np.tanh(g[:, 2 * h_ :] + r * u[:, 2 * h_ :])
            cache[t] = (h, z, r, c, u[:, 2 * h_ :])
            h = (h + z * (c - h)) * inside[:, t, None]
            out[:, t] = h
        hs.append(out)
        caches.append(cache)
    e = sum(hs[d] @ model.attend[d] for d in range(2)) + (inside - 1) * 1e9
    v = sum(hs[d] @ model.out[d] for d in range(2))
    a = np.exp(e - e.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    logit = (a * v).sum(axis=1) + model.bias
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    dl = ((p - y) / n).astype(np.float32)
    dv = a * dl[:, None]
    de = a * (v - (a * v).sum(axis=1, keepdims=True)) * dl[:, None]
    adam.step += 1
    dx = np.zeros_like(x)
    for d, cell in enumerate(model.cells):
        dh_all = de[:, :, None] * model.attend[d] + dv[:, :, None] * model.out[d]
        d_att, d_out = np.einsum("nt,nth->h", de, hs[d]), np.einsum("nt,nth->h", dv, hs[d])
        dw, du, db = np.zeros_like(cell["w"]), np.zeros_like(cell["u"]), np.zeros_like(cell["b"])
        dh = np.zeros((n, h_), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, z, r, c, uc = caches[d][t]
            dh = (dh + dh_all[:, t]) * inside[:, t, None]
            dz = dh * (c - h) * z * (1 - z)
            dc = dh * z * (1 - c * c)
            dr = dc * uc * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], axis=1)
            dgu = np.concatenate([dz, dr, dc * r], axis=1)
            dw += x[:, t].T @ dg
            db += dg.sum(axis=0)
            du += h.T @ dgu
            dx[:, t] += dg @ cell["w"].T
            dh = dh * (1 - z) + dgu @ cell["u"].T
        for name, value, grad in (("w", cell["w"], dw), ("u", cell["u"], du), ("b", cell["b"], db), ("att", model.attend[d], d_att), ("out", model.out[d], d_out)):
            adam.move(f"{name}{d}", value, grad)
    model.bias -= adam.rate * float(dl.sum())
    per = np.zeros((len(used), x.shape[2]), np.float32)
    np.add.at(per, back, (dx * inside[:, :, None]).reshape(n * steps, -1))
    rows, back = np.unique(word_rows, return_inverse=True)
    grad = np.zeros((len(rows), WORD_DIM), np.float32)
    np.add.at(grad, back, per[:, :WORD_DIM])
    adam.move("words", model.words, grad, rows)
    rows, back = np.unique(np.concatenate(shares), return_inverse=True)
    grad = np.zeros((len(rows), CHAR_DIM), np.float32)
    np.add.at(grad, back, (per[:, WORD_DIM:] / count[:, None])[np.concatenate(means)])
    adam.move("grams", model.grams, grad, rows)
    return float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())


@dataclass
class Picked:
    """The words of some windows, one after the other, as ``_learn`` reads them."""

    word: np.ndarray
    gram: list[np.ndarray]
    cuts: list[np.ndarray]
    begin: np.ndarray
    length: np.ndarray


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    return np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _pick(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> Picked:
    """The windows with these (sorted) numbers."""
    words, grams, sizes, lengths, seen = [], [[] for _ in GRAMS], [[] for _ in GRAMS], [], 0
    for _, _, read in reads(data, offsets):
        _, begin, length = read.windows()
        mine = chosen[np.searchsorted(chosen, seen) : np.searchsorted(chosen, seen + len(begin))] - seen
        seen += len(begin)
        begin, length = begin[mine], length[mine]
        at = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        words.append(read.word[at])
        lengths.append(length)
        for k in range(len(GRAMS)):
            size = read.cuts[k][at + 1] - read.cuts[k][at]
            pos = np.repeat(read.cuts[k][at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            grams[k].append(read.gram[k][pos])
            sizes[k].append(size)
    length = np.concatenate(lengths)
    cuts = [np.append(0, np.cumsum(np.concatenate(x))) for x in sizes]
    return Picked(np.concatenate(words), [np.concatenate(g) for g in grams], cuts, np.cumsum(length) - length, length)


def _swapped(picked: Picked, rows: np.ndarray, label: np.ndarray, clean: np.ndarray, typical: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Places of the words to learn from: in toxic windows most words that aren't typical of toxic
    documents are swapped for a clean window's, so that the network can't learn them by heart."""
    steps = int(picked.length[rows].max(initial=1))
    last = max(0, len(picked.word) - 1)
    at = np.minimum(picked.begin[rows][:, None] + np.arange(steps), last)
    if not len(clean) or not len(picked.word):
        return at
    donor = rng.choice(clean, len(rows))
    other = np.minimum(picked.begin[donor][:, None] + np.arange(steps) % np.maximum(picked.length[donor], 1)[:, None], last)
    swap = (label[rows] == 1)[:, None] & ~typical[at] & (rng.random(at.shape) < SWAP) & (picked.length[donor] > 0)[:, None]
    return np.where(swap, other, at)


def fit(texts: list[str], labels: list[int], *, seed: int = 11, rounds: int = 3, epochs: int = 2, batch: int = 128, rate: float = 0.01) -> ToxicModel:
    model = _fresh(seed)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        model.constant = 0.5 if not len(y) else float(y[0])
        return model
    data, offsets = _texts(texts)
    rng = np.random.default_rng(seed)
    # how typical a hashed word is of toxic documents: log of smoothed document rates
    has = np.zeros((2, 1 << WORD_BITS), np.int64)
    before, seen = -1, np.zeros(0, np.int64)
    for i, _, read in reads(data, offsets):
        key = np.unique(np.repeat(np.arange(read.n), np.diff(read.first)) << WORD_BITS | read.word)
        if i == before:  # another part of the same text
            key, seen = np.setdiff1d(key, seen), np.union1d(key, seen)
        else:
            before, seen = i, key
        for label in range(2):
            has[label] += np.bincount(key[y[i + (key >> WORD_BITS)] == label] & (1 << WORD_BITS) - 1, minlength=1 << WORD_BITS)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    odds = np.log((has[1] + 0.5) / (n1 + 1)) - np.log((has[0] + 0.5) / (n0 + 1))
    odds[has[1] < max(4, n1 // 100)] = 0
    adam, losses = _Adam(rate), []
    for turn in range(rounds):
        owners, scores = [], []
        for i, _, read in reads(data, offsets):
            owner, begin, length = read.windows()
            owners.append(owner + i)
            if turn:
                x = model.inputs(read)
                scores.append(model.all(x, begin, length))
            else:
                of_word = odds[read.word]
                scores.append(np.array([of_word[b : b + k].max(initial=-9) for b, k in zip(begin, length, strict=True)]))
        owner, score = np.concatenate(owners), np.concatenate(scores)
        order = np.lexsort((score, owner))
        worst = order[np.append(np.flatnonzero(owner[order][1:] != owner[order][:-1]), len(order) - 1)]  # each document's
        spare = rng.choice(np.flatnonzero(y[owner] == 0), min(int((y[owner] == 0).sum()), max(SPARE, 2 * len(y))), replace=False)
        chosen = np.unique(np.concatenate([worst, spare]))
        picked, label = _pick(data, offsets, chosen), y[owner[chosen]]
        typical = odds[picked.word] > 1
        bad, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        pick = np.concatenate([np.tile(bad, max(1, len(clean) // (4 * max(1, len(bad))))), clean])
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // len(pick)))):
            rng.shuffle(pick)
            losses.append(np.mean([_learn(model, picked, picked.begin[k], picked.length[k], label[k].astype(np.float32), adam, _swapped(picked, k, label, clean, typical, rng)) for k in (pick[i : i + batch] for i in range(0, len(pick), batch))]))
        adam.rate *= 0.5
    model.trained = {"documents": len(y), "windows": len(owner), "losses": [round(float(v), 4) for v in losses]}
    return model


def logits(model: ToxicModel, texts: list[str]) -> np.ndarray:
    """Each text's worst window's logit as the network gives it."""
    if model.constant is not None or not texts:
        return np.zeros(len(texts))
    p = np.clip(model.probabilities(*_texts(texts)), 1e-12, 1 - 1e-12)
    return (np.log(p / (1 - p)) - model.scale[1]) / model.scale[0]


def calibrate(model: ToxicModel, z: np.ndarray, labels: list[int], steps: int = 300) -> None:
    """Fits the logistic map from a document's worst logit to its probability."""
    y = np.array(labels, np.float64)
    if model.constant is not None or not len(y) or y.min() == y.max():
        return
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = np.maximum(q * (1 - q), 1e-6)
        g = np.array([((q - target) * z).sum(), (q - target).sum()]) + np.array([1e-3 * (a - 1), 0])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, g), -0.5, 0.5)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    if a > 0:
        model.scale = (float(a), float(b))


def fit_texts(texts: list[str], labels: list[int]) -> ToxicModel:
    """Learns from all texts, calibrated on what networks learned from half of some say of the other half."""
    model = fit(texts, labels)
    if model.constant is None:
        some, known = texts[:CALIBRATE_ROWS], labels[:CALIBRATE_ROWS]
        calibrate(model, crossed(some, known, fit, logits), known)
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS) -> ToxicModel:
    """``keep`` (a condition over ``labels``) says which labels may be learned."""
    sample = store.table(labelled(docs, labels, "toxic", F.lit(True) if keep is None else keep, rows), "sample")
    model = fitted(sample, rows, fit_texts)
    store.drop(sample)
    return model


def score(docs: DataFrame, model: ToxicModel, column: str = "score", text: str = "text") -> DataFrame:
    """Adds the score and ``worst_word``, the number of the worst window's first word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the tables' buckets

    @F.arrow_udf("struct<score:double,at:bigint>")
    def worst(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            p, at = shared.value.worst(*utf8(part))
            yield pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(at, pa.int64())], ["score", "at"])

    return docs.withColumn("_toxic", worst(F.col(text))).withColumn(column, F.col("_toxic.score")).withColumn("worst_word", F.col("_toxic.at")).drop("_toxic")


def keep_clean(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, with their columns as they were."""
    names = docs.columns
    scored = score(docs.select(*names), model, "_toxicity")
    return scored.where(F.col("_toxicity") < threshold).select(*names)
