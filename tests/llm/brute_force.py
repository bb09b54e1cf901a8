"""Plain-loop versions of operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter

from skyrill.llm import decontaminate as D


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def lines(texts, edits=2, least=24, exact_short=True):
    """Texts without repeated lines; lines under ``least`` characters go by equality alone, if at all."""
    occ = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if len(x) >= least or exact_short and x.strip()]
    known = sorted({x for _, _, x in occ})
    group = {x: x for x in known}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in known:
        for b in known:
            if a < b and min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                group[find(b)] = find(a)
    first = {}
    for i, p, x in occ:
        first.setdefault(find(x), (i, p))
    gone = {(i, p) for i, p, x in occ if first[find(x)] != (i, p)}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)]


def near(texts):
    """{place: (size of its set, smallest place reachable)}."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def leaks(texts, items):
    """{(doc, item): (score, question overlap, answer overlap)} by plain loops over every passage and part."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    parts = [(i, w[k : k + D.PART_WORDS]) for i, t in items for w in [words(t)] for k in range(0, len(w), D.PART_WORDS)]
    n, mean = len(parts), sum(len(p) for _, p in parts) / max(len(parts), 1)
    df = Counter(x for _, p in parts for x in set(p))
    weight = lambda x, p: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * p.count(x) * (D.K1 + 1) / (p.count(x) + D.K1 * (1 - D.B + D.B * len(p) / mean))
    runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def overlap(part, w):
        k = min(D.RUN_WORDS, len(part))
        return 1.0 if not k else len(runs(part, k) & runs(w, k)) / len(runs(part, k))

    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        passages = [set(w[k : k + 2 * D.PART_WORDS]) for k in range(0, max(len(w) - D.PART_WORDS, 1), D.PART_WORDS)]
        for i, p in parts:
            total = sum(weight(x, p) for x in set(p))
            score = max(sum(weight(x, p) for x in set(p) & s) / total for s in passages)
            if score >= D.THRESHOLD - 1e-9:
                out[d, i] = max(score, out.get((d, i), 0))
    verified = {}
    for (d, i), score in out.items():
        q, a = (overlap(words(x), words(texts[d])) for x in D._question_answer((dict(items)[i] or "").lower()))
        if 100 * q >= D.OVERLAP_PERCENT and 100 * a >= D.OVERLAP_PERCENT:
            verified[d, i] = (round(score, 9), round(q, 9), round(a, 9))
    return verified
