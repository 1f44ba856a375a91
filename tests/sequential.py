"""Plain sequential versions of graph operators, for small inputs."""

from __future__ import annotations

from collections import defaultdict


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def flip(d):
    return "r" if d == "f" else "f"


def canon(s):
    return min(s, rc(s)), ("f" if s < rc(s) else "r")


def debruijn(reads, k):
    """(coverage by K-mer, set of edges (src, sdir, ddir, dst))."""
    cov, edges = defaultdict(int), set()
    for s in reads:
        if len(s) <= k:
            continue
        for i in range(len(s) - k + 1):
            cov[canon(s[i : i + k])[0]] += 1
        for i in range(len(s) - k):
            (u, a), (v, b) = canon(s[i : i + k]), canon(s[i + 1 : i + 1 + k])
            edges |= {(u, a, b, v), (v, flip(b), flip(a), u)}
    return dict(cov), edges


def unitigs(cov, edges, k):
    """Sorted (canonical sequence, mean coverage) of all maximal chains; a ring begins at its smallest K-mer read forward."""
    out_of = defaultdict(list)
    for u, a, b, v in edges:
        out_of[u, a].append((v, b))

    def succ(x):
        if len(out_of[x]) != 1:
            return None
        v, b = out_of[x][0]
        if v == x[0] or len(out_of[v, flip(b)]) != 1:
            return None
        return v, b

    seen, out = set(), []

    def walk(x):
        path = [x]
        seen.add(x[0])
        while (y := succ(path[-1])) and y[0] not in seen:
            path.append(y)
            seen.add(y[0])
        s = path[0][0] if path[0][1] == "f" else rc(path[0][0])
        for v, b in path[1:]:
            s += (v if b == "f" else rc(v))[k - 1 :]
        out.append((min(s, rc(s)), round(sum(cov[v] for v, _ in path) / len(path), 6)))

    for v in sorted(cov):
        for d in "fr":
            back = succ((v, flip(d)))
            if v not in seen and back is None:
                walk((v, d))
    for v in sorted(cov):
        if v not in seen:
            walk((v, "f"))
    return sorted(out)
