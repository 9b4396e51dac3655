"""Slow and plain versions of the operators."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def knn(rows, every, k=5):
    import math

    good = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in good.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def near(docs):
    sets = {}
    for d, t in docs:
        w = SPACED.findall(lower(t).encode())
        sets[d] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    shared, has = Counter(), {}
    for d, s in sets.items():
        for x in s:
            has.setdefault(x, []).append(d)
    for ids in has.values():
        ids.sort()
        shared.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def contaminated(docs, bench, size=10):
    wins = {}
    for i, t in bench:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - size + 1)):
            if x := tuple(w[k : k + size]):
                wins.setdefault(x, set()).add(i)
    sizes, out = sorted({len(x) for x in wins}), []
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        hit, items = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    items |= wins[x]
                    hit[k : k + n] = [True] * n
        ids, longest = sorted(str(i) for i in items if i is not None), 0
        for _, x in bench:
            x = ALNUM.findall(lower(x))
            for i in range(len(w)):
                for j in range(len(x)):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    longest = max(longest, n if n >= min(size, len(x)) else 0)
        out.append((d, len(w), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), any(hit), longest))
    return out


def without_repeats(docs, size=13):
    """(doc_id, n_words, kept words) by row."""
    found, first = [(d, SPACED.findall((t or "").encode())) for d, t in docs], {}
    for d, w in found:
        for i in range(len(w) - size + 1):
            if d is not None:
                first[tuple(w[i : i + size])] = min(d, first.get(tuple(w[i : i + size]), d))
    out = []
    for d, w in found:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append((d, len(w), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def toxicity(docs, labels, hash_of, monotone, each=10, k=16):
    """Scores by row; labels are those that may be learned from, and hash_of orders terms that tie."""
    import numpy as np

    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def kinds(text):
        found = word.findall(lower(text).encode())
        yield found
        for g in (4, 5, 6):
            yield [x[i : i + g] for x in found if len(x) > g for i in range(len(x) - g + 1)]

    bad, good = Counter(), Counter()
    for d, t in docs:
        if d in labels:
            for terms in kinds(t):
                (bad if labels[d] else good).update(set(terms))
    nb, ng = sum(labels.values()), max(1, len(labels) - sum(labels.values()))
    z = {}
    for x, n in bad.items():
        share = (n + good[x]) / len(labels)
        value = np.float32((n / nb - good[x] / ng) / (share * (1 - share + 1e-9) * (1 / nb + 1 / ng)) ** 0.5)
        if value > 0:
            z[x] = value
    vocab = set()
    for d, t in docs:
        if labels.get(d):
            vocab |= set(sorted((x for terms in kinds(t) for x in set(terms) if x in z), key=lambda x: (-z[x], hash_of(x)))[:each])
    place = {x: i for i, x in enumerate(sorted(vocab, key=hash_of))}
    counts = [Counter(place[x] for terms in kinds(t) for x in terms if x in place) for _, t in docs]
    df = Counter(i for c in counts for i in c)
    idf = np.array([np.log((1 + len(docs)) / (1 + df[i])) + 1 for i in range(len(place))])

    def vector(c):
        v = np.zeros(len(place))
        for i, n in c.items():
            v[i] = (1 + np.log(n)) * idf[i]
        return v / (np.linalg.norm(v) or 1)

    groups, empty = {}, []
    for (d, _), c in zip(docs, counts, strict=True):
        if d in labels:
            at = sorted(c)
            key = np.array(at, np.uint16).tobytes(), np.array([c[i] for i in at], np.uint32).tobytes()
            (groups.setdefault(key, (c, []))[1] if c else empty).append(labels[d])
    groups = [groups[x] for x in sorted(groups)]
    base, votes = np.stack([vector(c) for c, _ in groups]), np.array([[y.count(0), y.count(1)] for _, y in groups], float)

    def vote(v, own=-1, label=0):
        sim = base @ v
        at = [i for i in sorted(range(len(sim)), key=lambda i: (-round(sim[i], 12), i))[:k] if sim[i] > 0]
        n = votes[at].copy()
        if own in at:
            n[at.index(own), label] -= 1
        n = (sim[at] ** 2) @ n
        return n[1] / n.sum() if n.sum() > 0 else 0.0

    points = sorted((vote(base[i], i, y), i, y) for i, (_, of) in enumerate(groups) for y in set(of))
    knots = monotone([(v, y, votes[i, y]) for v, i, y in points])
    of_empty = (sum(empty) + 0.01) / (len(empty) + 1) if empty else 0.0
    return [float(np.clip(np.interp(vote(vector(c)), *knots), 0, 1)) if c else of_empty for c in counts]
