"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width):
    w = words((text or "").translate(LOW))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_groups(docs, width, percent):
    """{id: (shingles, component)} of {id: text}."""
    sets = {d: shingles(t, width) for d, t in docs.items()}
    groups, holders = Groups(sets), defaultdict(list)
    for d in sorted(sets):
        shared = Counter(e for g in sets[d] for e in holders[g])
        for g in sets[d]:
            holders[g].append(d)
        for e, k in shared.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[e]) - k):
                groups.join(d, e)
    return {d: (len(s), groups.find(d)) for d, s in sets.items()}


def cut_repeats(docs, width):
    """{id: (n_words, n_removed, kept)} of {id: text}, ids in ascending order."""
    seen, out = set(), {}
    for d in sorted(docs):
        w, gone = words(docs[d]), set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if key in seen:
                gone.update(range(i, i + width))
            seen.add(key)
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def drop_lines(docs, width=3):
    """{id: (n_lines, n_removed, text)} of {id: text}."""
    seen, out = set(), {}
    for d in sorted(docs):
        if docs[d] is None:
            out[d] = (0, 0, None)
            continue
        lines, gone = docs[d].split("\n"), set()
        for i in range(len(lines) - width + 1):
            key = tuple(lines[i:i + width])
            if key in seen:
                gone.update(range(i, i + width))
            seen.add(key)
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
