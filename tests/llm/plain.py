"""Plain Python versions of the operators, for small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FLOORS = np.array([0.04, 0.06, 0.15, 0.12])


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(lines), len(cover)


def base_failed(stats):
    return stats[0] < 50 or 100 * stats[5] > 50 * stats[0]


def vector(stats):
    words, chars, symbols, repeated, lines, covered = stats
    words = max(1, words)
    rates = math.log(max(1, chars) / words), math.sqrt(symbols / words), math.sqrt(repeated / max(1, lines)), math.sqrt(covered / words)
    return [math.floor(min(16, max(-16, r)) * 256 + 0.5) for r in rates]


def floored(cov):
    own = np.sqrt(np.diag(cov))
    out = np.zeros((4, 4))
    for i in range(4):
        for j in range(4):
            r = 1.0 if i == j else (cov[i, j] / own[i] / own[j] if own[i] and own[j] else 0.0)
            out[i, j] = (r * 0.999 + (0.001 if i == j else 0)) * max(own[i], FLOORS[i]) * max(own[j], FLOORS[j])
    return out


def bin_of(d2):
    return math.floor(math.log1p(1000 * max(0.0, d2)) * 50)


def distance(x, centre, cov):
    d = x / 256 - centre
    return float(d @ np.linalg.inv(floored(cov)) @ d)


def closer(rows, bins):
    limit = sorted(bins)[(len(bins) - 1) // 2]
    near = rows[[b <= limit for b in bins]] / 256
    return near.mean(0), np.cov(near.T, bias=True)


def slow_mcd(rows, steps=20):
    """(centre, covariance) of the better of two starts; every row is looked at in every step."""
    rows = np.array(rows, float)
    middle = np.sort(rows, axis=0)[(len(rows) - 1) // 2]
    spread = np.sort(abs(rows - middle), axis=0)[(len(rows) - 1) // 2] * 1.4826 / 256
    z = (rows - middle) / 256 / np.maximum(spread, FLOORS)
    found = []
    for bins in ([bin_of(v) for v in (z * z).sum(1)], [bin_of(v) for v in abs(z).max(1)]):
        fit = closer(rows, bins)
        for _ in range(steps):
            after = closer(rows, [bin_of(distance(x, *fit)) for x in rows])
            if np.linalg.slogdet(floored(after[1]))[1] >= np.linalg.slogdet(floored(fit[1]))[1] - 1e-9:
                break
            fit = after
        found.append((np.linalg.slogdet(floored(fit[1]))[1], fit))
    return min(found, key=lambda x: round(x[0], 9))[1]


def verdicts(rows, prior=100):
    """[(statistics, base failed, distance or None)] of (text, lang, source) rows."""
    stats = [statistics(t) for t, _, _ in rows]
    groups = defaultdict(list)
    for s, (_, lang, source) in zip(stats, rows, strict=True):
        if not base_failed(s):
            for g in ((), (lang,), (lang, source)):
                groups[g].append(vector(s))
    fits = {g: (*slow_mcd(v), len(v)) for g, v in groups.items()}
    drawn = {}
    for g in fits:
        if len(g) == 2:
            centre, cov = fits[()][:2]
            for level in (g[:1], g):
                own, n = fits[level][:2], fits[level][2]
                centre, cov = (n * own[0] + prior * centre) / (n + prior), (n * own[1] + prior * cov) / (n + prior)
            bins = sorted(bin_of(distance(np.array(v), centre, cov)) for v in groups[g])
            scale = max(1.0, math.expm1(bins[(len(bins) - 1) // 2] / 50) / 1000 / 3.3566939800333224)
            drawn[g] = centre, cov, scale
    out = []
    for s, (_, lang, source) in zip(stats, rows, strict=True):
        fit = drawn.get((lang, source))
        out.append((s, base_failed(s), None if fit is None else distance(np.array(vector(s)), *fit[:2]) / fit[2]))
    return out


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(sets):
    """The smallest position linked with each set at a similarity of 0.75 or more; None where it is empty."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) if s else None for k, s in enumerate(sets)]


def removed(rows, length=50):
    """For (id, bytes) rows in order: the flags of the bytes that go."""
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out.append(gone)
    return out


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
