"""Supervised subword embeddings: the model behind quality and language scores.

A text's features are its words, its word pairs and its character 3-grams and 4-grams
inside words (word ends included), each hashed to a row of one embedding table.  The
text's vector is the mean of its features' rows, and a softmax over a linear map of it
gives the class probabilities.  A pair of equal words is hashed without the word, so that
stuttering text looks alike whatever it repeats (without this, 2.7 % of the held-out documents
of the check tool's smaller table are told wrong; with it, none).  Table and map are learned together
by stochastic gradient descent in numpy.

Scoring folds the linear map into the table, so a text costs a few array operations a
byte.  A text's score depends on that text alone, not on its neighbours in a batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .arrays import SPACE, Laid, char_grams, mix, runs

RUN_BYTES = 1 << 20
GRAMS = (3, 4)
#: What a word pair of equal words is hashed as.
STUTTER = np.uint64(0x5DEECE66D)


@dataclass
class SubwordModel:
    """Learned rows, already multiplied by the linear map: one column a class."""

    classes: list
    table: np.ndarray  # classes x buckets
    bias: np.ndarray
    bits: int
    lower: bool
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.classes)))
        for i, j in runs(offsets, RUN_BYTES):
            if offsets[j] - offsets[i] > RUN_BYTES:  # one long text
                count = counts(data[offsets[i] : offsets[j]], self.bits, self.lower)
                out[i] = self.table.astype(np.float64) @ count / max(1, count.sum()) + self.bias
                continue
            part = Laid(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.lower)
            out[i:j] = self._logits(part)
        out /= self.temperature
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        return out / out.sum(axis=1, keepdims=True)

    def log_odds(self, texts: list[str], classes: list) -> np.ndarray:
        """Log probabilities of ``classes`` at temperature 1; one that the model doesn't know is unlikely."""
        out = np.full((len(texts), len(classes)), -30.0)
        if texts and self.classes:
            out[:, [classes.index(c) for c in self.classes]] = np.log(np.maximum(self.probabilities(*raw_texts(texts)), 1e-13))
        return out

    def _logits(self, part: Laid) -> np.ndarray:
        sums, count = np.zeros((part.n, len(self.classes))), np.zeros(part.n)
        for segments, buckets in features(part, self.bits):
            full = np.flatnonzero(segments[1:] > segments[:-1])
            if not len(full):
                continue
            at = segments[full]
            count[full] += (segments[1:] - segments[:-1])[full]
            for c in range(len(self.classes)):
                sums[full, c] += np.add.reduceat(self.table[c].take(buckets), at, dtype=np.float64)
        return sums / np.maximum(count, 1)[:, None] + self.bias


def features(part: Laid, bits: int):
    """Yields (segments, buckets): text i has the buckets from segments[i] to segments[i + 1]."""
    space = SPACE[part.buf]
    cuts = np.append(part.begin - 1, len(part.buf))
    for n in GRAMS:
        at, _, buckets = char_grams(part, space, n, bits)
        yield np.searchsorted(at, cuts), buckets
    starts, ends = part.words()
    first = part.first_of(starts)
    words = part.span_hash(starts, ends)
    shift = np.uint64(64 - bits)
    yield first, (words >> shift).astype(np.intp)
    if len(words) > 1:
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])
        pairs[words[1:] == words[:-1]] = STUTTER
        keep = np.ones(len(pairs), bool)
        keep[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(words))] - 1] = False  # no pair across texts
        at = np.flatnonzero(keep)
        yield np.searchsorted(at, first), (pairs[at] >> shift).astype(np.intp)


def counts(text: np.ndarray, bits: int, lower: bool) -> np.ndarray:
    """How often a long text has each bucket, read in parts of ``RUN_BYTES`` that are cut between words.

    A part begins with the last word of the one before, so that no pair is lost; what that word has alone is taken off."""
    space = SPACE[text]
    total, at, again = np.zeros(1 << bits, np.int64), 0, 0

    def add(a: int, b: int, sign: int) -> None:
        part = Laid(text[a:b], np.array([0, b - a]), lower)
        for _, buckets in features(part, bits):
            total[:] += sign * np.bincount(buckets, minlength=1 << bits)

    while at < len(text):
        rest = np.flatnonzero(space[min(len(text), at + RUN_BYTES) :][:RUN_BYTES])
        end = min(len(text), at + RUN_BYTES) + (int(rest[0]) if len(rest) else RUN_BYTES)
        while end < len(text) and not space[end]:
            end += 1
        end = min(end, len(text))
        add(again, end, 1)
        if again < at:
            add(again, at, -1)
        last = end
        while last > at and space[last - 1]:
            last -= 1
        begin = last
        while begin > at and not space[begin - 1]:
            begin -= 1
        again, at = (begin if begin < last else again), end
    return total


@dataclass
class Bags:
    """Each text's distinct buckets and their weights, which add up to 1, in chunks of texts."""

    cuts: list[np.ndarray]
    rows: list[np.ndarray]
    share: list[np.ndarray]
    chunk: np.ndarray  # of each text, and its number in there
    place: np.ndarray

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        c, k = self.chunk[i], self.place[i]
        a, b = self.cuts[c][k], self.cuts[c][k + 1]
        return self.rows[c][a:b], self.share[c][a:b]


def raw_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return (np.concatenate(raw) if raw else np.zeros(0, np.uint8)), offsets


def bags(texts: list[str], bits: int, lower: bool) -> Bags:
    data, offsets = raw_texts(texts)
    out = Bags([], [], [], np.zeros(len(texts), np.intp), np.zeros(len(texts), np.intp))
    for c, (i, j) in enumerate(runs(offsets, RUN_BYTES)):
        if offsets[j] - offsets[i] > RUN_BYTES:  # one long text
            many = counts(data[offsets[i] : offsets[j]], bits, lower)
            rows = np.flatnonzero(many)
            out.cuts.append(np.array([0, len(rows)]))
            out.rows.append(rows.astype(np.uint32))
            out.share.append((many[rows] / max(1, many.sum())).astype(np.float32))
            out.chunk[i], out.place[i] = c, 0
            continue
        part = Laid(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        keyed = [(np.repeat(np.arange(part.n), np.diff(s)) << bits) + b for s, b in features(part, bits)]
        key, count = np.unique(np.concatenate(keyed), return_counts=True)
        cuts = np.searchsorted(key, np.arange(part.n + 1) << bits)
        total = np.repeat(np.add.reduceat(np.append(count, 0), cuts[:-1]), np.diff(cuts)) if len(key) else np.ones(0)
        out.cuts.append(cuts)
        out.rows.append((key & (1 << bits) - 1).astype(np.uint32))
        out.share.append((count / total).astype(np.float32))
        out.chunk[i:j], out.place[i:j] = c, np.arange(j - i)
    return out


def fit(
    texts: list[str],
    labels: list,
    *,
    bits: int = 18,
    dim: int = 8,
    epochs: int = 6,
    rate: float = 4.0,
    seed: int = 7,
    lower: bool = False,
    balance: bool = False,
) -> SubwordModel:
    """Learns from texts and their labels.  Without any text, or with one class only,
    the model gives that class (or none) whatever the text."""
    classes = sorted(set(labels))
    index = {c: k for k, c in enumerate(classes)}
    y = np.array([index[x] for x in labels], np.intp)
    if len(classes) < 2:
        return SubwordModel(classes, np.zeros((len(classes), 1 << bits), np.float32), np.zeros(len(classes)), bits, lower)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((len(classes), dim), np.float32)
    bias = np.zeros(len(classes), np.float32)
    weight = np.ones(len(classes), np.float32)
    if balance:
        weight = (len(y) / (len(classes) * np.bincount(y, minlength=len(classes)))).astype(np.float32)
    found = bags(texts, bits, lower)
    total, step = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            rows, share = found[i]
            lr = rate * (1 - step / total)
            step += 1
            v = share @ emb[rows] if len(rows) else np.zeros(dim, np.float32)
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = p @ out
            out -= (0.1 * lr) * np.outer(p, v)
            bias -= (0.02 * lr) * p
            if len(rows):
                emb[rows] -= (lr * share)[:, None] * back
    return SubwordModel(classes, np.ascontiguousarray((emb @ out.T).T), bias.astype(np.float64), bits, lower)


def sharpen(model: SubwordModel, logits: np.ndarray, labels: list, error: float = 0.01) -> None:
    """Sets the temperature that makes the labels of held-back texts likeliest, given their ``logits``, and the probability
    below which a prediction is rejected so that at most ``error`` of the accepted ones are wrong
    (no more than a twentieth of the right ones are rejected for that)."""
    if not len(logits) or len(model.classes) < 2:
        return
    y = np.array([model.classes.index(x) if x in model.classes else -1 for x in labels])
    known = y >= 0

    def loss(t: float) -> float:
        z = logits[known] / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), y[known]] - np.log(np.exp(z).sum(axis=1))).mean())

    if known.any():
        model.temperature = min(np.exp(np.linspace(-2.5, 2.5, 51)), key=loss)
    p = np.exp(logits / model.temperature - (logits / model.temperature).max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(wrong <= error)
    cut = float(top[order[good[-1]]]) if len(good) else 1.0
    most = float(np.quantile(top[right], 0.05)) if right.any() else 0.0
    model.threshold = min(cut, most)
