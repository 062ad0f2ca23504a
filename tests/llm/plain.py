"""Plain versions that the operators are held against, by all pairs and single loops."""

import re
from fractions import Fraction

import xxhash


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def simhash(text):
    w = spaced(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps):
    """Index of the smallest member of each one's component, by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def contained(docs, items, window):
    """(words, hit words, sorted items) of each document."""
    wins = {}
    for item, body in items:
        w = words(body)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add("null" if item is None else str(item))
    out = []
    for text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(w) for w in wins}:
            for j in range(len(own) - n + 1):
                if (win := tuple(own[j : j + n])) in wins:
                    hit.update(range(j, j + n))
                    found |= wins[win]
        out.append((len(own), len(hit), sorted(found)))
    return out


def water(sizes, weights, ratio, cap):
    """Targets by resharing until none is above; exact."""
    total, out, left = Fraction(sum(sizes)) * Fraction(ratio), {}, set(range(len(sizes)))
    while left:
        w = sum(weights[i] for i in left)
        rest = total - sum(out.values())
        over = [i for i in left if rest * weights[i] / w > cap * sizes[i]]
        if not over:
            return [float(out.get(i, rest * weights[i] / w)) for i in range(len(sizes))]
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            left.discard(i)
    return [float(out[i]) for i in range(len(sizes))]
