"""Plain versions of what the operators must return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, k):
    w = words(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, num, den):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    where = defaultdict(list)
    for i in sorted(sets):
        met = Counter(j for s in sets[i] for j in where[s])
        for j, n in met.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    """(counts by kind, spans as kind:start:end in order)."""
    found, counts = [], []
    for order, (kind, pattern) in enumerate(KINDS.items()):
        n = 0
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
                n += 1
        counts.append(n)
    said = ",".join(s for _, _, s in sorted(found))
    return counts, said


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(b):
    return zlib.crc32(b)


def top_k(vectors, queries, k):
    """query id -> [(score, id)] by integer inner product."""
    ids = np.array(list(vectors))
    x = np.floor(1024 * np.array([vectors[i] for i in ids], float)).astype(np.int64)
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(s[i]), int(ids[i])) for i in order]
    return out


def nearest(vectors, queries, k):
    ids = np.array(list(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(float(d[i]), int(ids[i])) for i in order]
    return out
