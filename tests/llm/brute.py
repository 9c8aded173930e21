"""Plain versions that the operators are held against."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(5)]))


def near_groups(rows):
    """doc_id -> (n_shingles, component) of rows (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    common = Counter(p for ids in held.values() for p in itertools.combinations(ids, 2))
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    roots = union_find(sets, links)
    return {i: (len(s), roots[i]) for i, s in sets.items()}


def near_vectors(rows, least):
    """vec_id -> (n_links, component) of rows (vec_id, embedding, label)."""
    links, units = [], {}
    for i, v, label in rows:
        ok = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units[i] = (label, np.array(v, float)) if ok else None
    for a, b in itertools.combinations(units, 2):
        if units[a] and units[b] and units[a][0] == units[b][0]:
            x, y = units[a][1], units[b][1]
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((a, b))
    count = Counter(i for pair in links for i in pair)
    roots = union_find(units, links)
    return {i: (count[i], roots[i]) for i in units}


def edits(a, b):
    """Insertions and deletions that turn one sequence into the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]
