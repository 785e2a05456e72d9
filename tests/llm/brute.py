"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def plain(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact(rows: list[tuple]) -> dict:
    """(doc_id, text) rows with distinct ids -> doc_id: (keep_id, group_size, kept, sha256)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[plain(text)].append((-len(text or ""), doc_id))
    out = {}
    for p, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(p.encode()).hexdigest())
    return out


def grams(text: str | None, size: int = 5) -> frozenset:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def near(rows: list[tuple], least: float = 0.8) -> dict:
    """doc_id: (class_id, n_copies, n_links, group_id, kept) by measuring all pairs that share a gram."""
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[grams(text)].append(doc_id)
    sets = sorted(classes, key=lambda s: min(classes[s]))
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    shared = defaultdict(int)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    links, parent = defaultdict(int), list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            links[a] += 1
            links[b] += 1
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    out = {}
    for k, s in enumerate(sets):
        stay = min(classes[sets[root(k)]])
        for doc_id in classes[s]:
            out[doc_id] = (min(classes[s]), len(classes[s]), links[k], stay, doc_id == stay)
    return out
