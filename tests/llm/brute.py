"""Plain-Python definitions that the operators are held against."""

import hashlib
import re
import string
from collections import Counter

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, size=20):
    seen, out = {}, []
    for row, (i, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            key = tuple(words[k : k + size])
            if seen.setdefault(key, (row, k)) != (row, k):
                gone[k : k + size] = [True] * size
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), sha(kept), kept))
    return out


def exact_groups(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def shingles(text):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def near_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for k in s:
            where.setdefault(k, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for k in s for j in where[k] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contaminated(docs, items, window=10):
    phrases = {}
    for i, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            phrases.setdefault(tuple(words[k : k + n]), set()).add(i)
    out = {}
    for i, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = [False] * len(words), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(words) - n + 1):
                own = phrases.get(tuple(words[k : k + n]))
                if own:
                    found |= own
                    hit[k : k + n] = [True] * n
        out[i] = (len(words), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit))
    return out
