"""Plain versions of operators that several tests compare with."""

import collections
import re
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_classes(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return collections.Counter((d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def plain_targets(sizes, weights=(3, 1, 2), budget=150, most=2):
    """Targets by the rule as it is told: the excess of a full source goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), Fraction(budget * sum(sizes.values()), 100)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out
