"""Plain near-duplicate detection, pair by pair."""

import re


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """{doc_id: (size, least doc_id reachable)} for (doc_id, text) pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    seen = set()
    for k, (i, s) in enumerate(sets):
        near = {}
        for x in s:
            for j in holders[x]:
                if j > k:
                    near[j] = near.get(j, 0) + 1
        for j, common in near.items():
            other = sets[j][1]
            if (k, j) not in seen and 100 * common >= 75 * (len(s) + len(other) - common):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}
