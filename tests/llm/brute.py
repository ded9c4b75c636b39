"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def words(text):
    return (text or "").encode().lower().split()


def alnum(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def components(rows, k, num, den):
    """(number of shingles, least id reachable, direct links) by id."""
    sets = {i: shingles(words(t), k) for i, t in rows}
    u, links = Union(sets), Counter()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * den >= num * len(sets[a] | sets[b]):
                u.join(a, b)
                links[a] += 1
                links[b] += 1
    return {i: (len(sets[i]), u.find(i), links[i]) for i in ids}


def repeated_bytes(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + length] for _, b in raw for j in range(len(b) - length + 1))
    out = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def contamination(docs, items, window=8):
    phrases: dict[tuple, set[str]] = {}
    for i, t in items:
        w = alnum(t)
        for j in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[j : j + window]), set()).add("" if i is None else str(i))
    out = Counter()
    for i, t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in {len(p) for p in phrases}:
            for j in range(len(w) - n + 1):
                p = tuple(w[j : j + n])
                if p in phrases:
                    hit.update(range(j, j + n))
                    found |= phrases[p]
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2] += 1
    return out


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def water_fill(sizes):
    """Targets by source: weights 1, 2, 3, repeating by code point, null last; reshared until none is over three times its size."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    left = float(total)
    while left > 1e-9:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        left = 0.0
        for s in rest:
            target[s] += share[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
    return target
