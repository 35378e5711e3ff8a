"""Plain models of the operators, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles_of(text, n):
    words = words_of(text)
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_components(docs, n=3, percent=85):
    """{doc_id: (set size, smallest identifier reachable)} of (doc_id, text) with distinct identifiers."""
    sets = {i: shingles_of(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def without_repeats(docs, length=100):
    """[(doc_id, bytes, removed, spans, sha256 of the rest)] of (doc_id, text), in the given order."""
    seen, out = set(), []
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(window)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes, weights, most=3):
    """Budgets of sources in order: shared by weight, capped, and the excess shared again."""
    total = float(sum(sizes))
    capped: set[int] = set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i % len(weights)] for i in free)
        share = {i: left * weights[i % len(weights)] / weight for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            return [float(most * sizes[i]) if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def kneser_ney(texts, order, fallback=0.5):
    """Bits of the last character of a string of ``order`` characters, by an interpolated modified Kneser-Ney model in dictionaries."""
    counts = {order: Counter()}
    for text in texts:
        padded = "\2" * (order - 1) + (text or "")
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    cuts, totals, left = {}, {}, {}
    for k, grams in counts.items():
        n = [sum(v == i for v in grams.values()) for i in (1, 2, 3, 4)]
        base = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        found = [i - (i + 1) * base * n[i] / n[i - 1] if n[i - 1] else 0 for i in (1, 2, 3)]
        cuts[k] = [c if 0 < c < i else fallback * i for i, c in enumerate(found, 1)]
        totals[k], left[k] = Counter(), defaultdict(float)
        for gram, v in grams.items():
            totals[k][gram[:-1]] += v
            left[k][gram[:-1]] += cuts[k][min(v, 3) - 1]

    def chance(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        context = gram[:-1]
        if context not in totals[k]:
            return chance(gram[1:])
        v = counts[k][gram]
        own = v - cuts[k][min(v, 3) - 1] if v else 0.0
        return (own + left[k][context] * chance(gram[1:])) / totals[k][context]

    return lambda gram: -math.log2(chance(gram))
