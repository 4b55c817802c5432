"""Plain-Python counterparts of the operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    text, w = text or "", words(text)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if triples[t] >= 2 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def shingles(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def near(docs, percent=85):
    """(doc_id, text) rows: doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs}
    ids, links = sorted(sets), []
    at = defaultdict(set)
    for d in ids:
        for s in sets[d]:
            at[s].add(d)
    for a in ids:
        for b in {b for s in sets[a] for b in at[s] if b > a}:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    parts = components(ids, links)
    return {d: (len(sets[d]), parts[d]) for d in ids}


def removed_words(docs, window=50):
    """doc_id -> flags of removed words."""
    first = {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    out = {}
    for d, w in split.items():
        flags = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                flags[i:i + window] = [True] * window
        out[d] = flags
    return out


def removed_bytes(docs, window=400):
    """[(doc_id, text)] -> flags of removed bytes for each row, in row order."""
    data = [(t or "").encode() for _, t in docs]
    times = Counter(b[i:i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        flags = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if times[b[i:i + window]] > 1:
                flags[i:i + window] = b"\1" * window
        out.append(flags)
    return out
