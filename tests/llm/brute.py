"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def shingles(text: str | None, n: int) -> list[str]:
    w = WORD.findall(lower(text or ""))
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []


def simhash(text: str | None, n: int = 3) -> int:
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n: int, linked) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def repeats(rows: list[tuple], length: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept) of each (place, text)."""
    first: dict[bytes, float] = {}
    for place, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            first[g] = min(first.get(g, place), place)
    out = []
    for place, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < place:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def line_runs(rows: list[tuple], least: int) -> list[set[int]]:
    """Lines that go of each (place, text): those of runs of ``least`` words or more that stand earlier."""
    seqs = []
    for place, text in rows:
        lines = [(i, line.strip(" \t\n\r\x0b\x0c"), len(WORD.findall(line))) for i, line in enumerate((text or "").split("\n"))]
        seqs.append((place, [x for x in lines if x[2]]))
    first: dict[tuple, tuple] = {}
    runs = []
    for d, (place, seq) in enumerate(seqs):
        for s in range(len(seq)):
            words = 0
            for e in range(s, len(seq)):
                words += seq[e][2]
                if words >= least:
                    key = tuple(x[1] for x in seq[s : e + 1])
                    here = (place, seq[s][0])
                    runs.append((d, key, here, seq[s][0], seq[e][0]))
                    first[key] = min(first.get(key, here), here)
    gone = [set() for _ in rows]
    for d, key, here, s, e in runs:
        if here > first[key]:
            gone[d] |= set(range(s, e + 1))
    return gone


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def targets(sizes: dict, weights: list[float], cap: float) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else rest * w[s] / share for s in names}
        more = {s for s in names if s not in full and t[s] > cap * sizes[s]}
        if not more:
            return t
        full |= more


def spark_hash(*values) -> int:
    """Spark's 64-bit hash of ints (as 4 bytes, in a tuple of one), longs and strings, one after another, signed."""
    h = 42
    for v in values:
        if v is not None:
            raw = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode()
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def mix(rows: list[tuple], weights: list[float], cap: float, seed: int, tries: int, run: int) -> Counter:
    """(id, size, taken) of (id, source, text): each document in turn takes the integers that its stretch of the running sum passes."""
    sources: dict = {}
    for i, s, t in rows:
        sources.setdefault(s, []).append((len(WORD.findall(t or "")), spark_hash((seed,), i), i is not None, i))
    goal = targets({s: sum(d[0] for d in docs) for s, docs in sources.items()}, weights, cap)
    out: Counter = Counter()
    for s, docs in sources.items():
        # Nulls come first in an ascending order.
        docs.sort(key=lambda d: (d[0], d[1], d[2], d[3] or 0))
        total = sum(d[0] for d in docs)
        rate = goal[s] / total if total else 0.0
        start = spark_hash((seed,), "offset", s) % (1 << 30) / float(1 << 30)
        best = None
        for k in range(tries):
            offset, turn = math.fmod(start + k / tries, 1.0), k % run
            taken = []
            for r in range(0, len(docs), run):
                block = docs[r : r + run]
                for j, d in enumerate(block):
                    at = r + (j + turn) % len(block)
                    taken.append((math.floor((at + 1) * rate + offset) - math.floor(at * rate + offset)) * d[0])
            key = (abs(sum(taken) - goal[s]), offset, turn)
            if best is None or key < best[0]:
                best = (key, taken)
        out += Counter((d[3], d[0], t) for d, t in zip(docs, best[1], strict=True))
    return out


def toxicity(text: str | None, weights: dict[int, float], bias: float, buckets: int) -> float:
    """The noisy-or of the sentences' logistic scores, from the weights of a model."""
    none = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", sentence)
        if not words or not weights:
            continue
        x = bias
        for w in words:
            for f in [f"={w}", *(f"^{w[:n]}" for n in (4, 5, 6, 7) if len(w) >= n)]:
                x += weights.get(zlib.crc32(f.encode()) % buckets, 0.0)
        none *= 1 - 1 / (1 + math.exp(-max(-30, min(30, x))))
    return 1 - none


def sha256(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def multiset(rows) -> Counter:
    return Counter(map(tuple, rows))
