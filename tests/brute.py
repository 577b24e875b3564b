"""Plain NumPy restatements of the clustering method for small test inputs."""

import numpy as np


def prim(x, min_samples=1, metric="l2"):
    d = np.abs(x[:, None] - x[None]).sum(2) if metric == "manhattan" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1)]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    n = len(x)
    best, link, left = m[0].copy(), np.zeros(n, int), set(range(1, n))
    edges = []
    while left:
        j = min(left, key=lambda t: (best[t], t))
        edges.append((best[j], link[j], j))
        left.discard(j)
        for t in left:
            if m[j, t] < best[t]:
                best[t], link[t] = m[j, t], j
    return sorted((w, min(a, b), max(a, b)) for w, a, b in edges)


def labels(x, size, method="eom", epsilon=0.0, min_samples=1, metric="l2"):
    n = len(x)
    kids, points, weight = {}, {i: [i] for i in range(n)}, {}
    name = {i: i for i in range(n)}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    node_of, nxt = {i: i for i in range(n)}, n
    for w, a, b in prim(x, min_samples, metric):
        ra, rb = find(a), find(b)
        kids[nxt], weight[nxt] = (node_of[ra], node_of[rb]), w
        points[nxt] = points[node_of[ra]] + points[node_of[rb]]
        name[rb] = ra
        node_of[ra] = nxt
        nxt += 1
    root = nxt - 1
    lam = lambda t: 1 / weight[t] if weight[t] > 0 else 1e12
    tree, stab, parent, birth, fell = {}, {}, {}, {}, {}

    def grow(top, par, b):
        c, parent[top], birth[top], tree[top], stab[top] = top, par, b, [], 0.0
        todo = [top]
        while todo:
            t = todo.pop()
            l, r = kids[t]
            big = [len(points[s]) >= size for s in (l, r)]
            for s, ok in zip((l, r), big):
                if all(big):
                    tree[c].append(s)
                    stab[c] += (lam(t) - b) * len(points[s])
                    grow(s, c, lam(t))
                elif ok:
                    todo.append(s)
                else:
                    for p in points[s]:
                        fell[p] = c
                        stab[c] += lam(t) - b

    import sys

    sys.setrecursionlimit(10000)
    grow(root, None, 0.0)
    if method == "leaf":
        chosen = {c for c in tree if not tree[c] and c != root}
    else:
        value, win = {}, {}
        for c in sorted(tree):
            s = sum(value[k] for k in tree[c])
            win[c], value[c] = stab[c] >= s, max(stab[c], s)
        chosen = set()

        def pick(c):
            if win[c] and c != root:
                chosen.add(c)
            else:
                for k in tree[c]:
                    pick(k)

        pick(root)
    if epsilon > 0:
        out = set()
        for c in chosen:
            if 1 / birth[c] < epsilon:
                while parent[c] != root and not 1 / birth[c] > epsilon:
                    c = parent[c]
            out.add(c)
        chosen = out
    got = []
    for p in range(n):
        c = fell[p]
        while c is not None and c not in chosen:
            c = parent[c]
        got.append(c)
    seen = {}
    return [-1 if c is None else seen.setdefault(c, len(seen)) for c in got]
