"""Plain answers to compare with."""

import hashlib
from itertools import combinations


def brute_components(docs, n, percent=80):
    sets = {}
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        size = min(n, len(words))
        sets[doc_id] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def brute_bytes(docs, length):
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = [False] * len(data)
        for start in range(len(data) - length + 1):
            string = data[start : start + length]
            if string in seen:
                gone[start : start + length] = [True] * length
            seen.add(string)
        n_spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out
