"""Suffix array by linear grouping (Baier 2016).

Suffixes are first grouped by their first symbol. Groups are processed in descending order: each member points to the nearest earlier
suffix of a smaller group, and the suffixes pointed at move into new groups right above their old one, those with more pointers higher.
At the end a group holds the suffixes with one Lyndon prefix. A second sweep emits the array: when a suffix is emitted, the one before it
and the chain of previous-smaller suffixes from there take the front places of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ``symbols`` (non-negative integers); the end counts as smaller than any symbol."""
    n = len(symbols) + 1
    text = np.zeros(n, np.int64)
    text[:-1] = symbols.astype(np.int64) + 1
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ends = np.append(starts[1:], n)
    link = np.empty(n, np.int64)  # the group of a suffix, named by its first place
    link[order] = np.repeat(starts, ends - starts)
    group, prev, size = link.tolist(), [-1] * n, [0] * n
    first_of = [0] * (n + 1)  # first place of the group that ends at a place
    members: dict[int, list[int]] = {}
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        size[s] = e - s
        first_of[e] = s
        members[s] = order[s:e].tolist()

    top = n
    while top > 0:
        start = first_of[top]
        here = members.pop(start)
        if len(here) != size[start]:  # some have moved on
            here = [i for i in here if group[i] == start]
        top = start
        if len(here) == 1:
            i = here[0]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                old = group[j]
                m = size[old]
                if m > 1:
                    new = old + m - 1
                    size[old], size[new] = m - 1, 1
                    first_of[new + 1], first_of[new] = new, old
                    group[j] = new
                    members[new] = [j]
            continue
        here.sort()
        pointed: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, times in pointed.items():
            by_count.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(by_count, reverse=True):
            for old, moved in by_count[times].items():
                m, k = size[old], len(moved)
                if k == m:
                    continue  # the whole group moves: its place stays
                new = old + m - k
                size[old], size[new] = m - k, k
                first_of[new + k], first_of[new] = new, old
                for j in moved:
                    group[j] = new
                members[new] = moved

    out, front, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = prev[j]
    return np.array(out[1:], np.int64)


def repeated_windows(pieces: list, width: int) -> list[np.ndarray]:
    """For each piece (bytes, or non-negative integers) the starts of its strings of ``width`` symbols that also start somewhere else in the pieces."""
    lengths = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbols = np.zeros(int(begin[-1]), np.int64)
    for p, b in zip(pieces, begin[:-1].tolist(), strict=True):
        symbols[b : b + len(p)] = np.frombuffer(p, np.uint8) if isinstance(p, bytes) else p
        symbols[b : b + len(p)] += 1  # 0 ends a piece
    order = suffix_array(symbols)
    owner = np.searchsorted(begin, order, "right") - 1
    whole = order + width <= begin[owner] + lengths[owner]
    # equal strings stand together: it is enough to compare neighbours
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero(whole[:-1] & whole[1:])
    for step in (width, max(1, width // 6), 1):  # far ends first, then all of it
        at = np.unique(np.concatenate([np.arange(0, width, step), [width - 1]]))
        same = np.ones(len(pair), bool)
        for o in at.tolist():
            same &= symbols[a[pair] + o] == symbols[b[pair] + o]
        pair = pair[same]
    hit = np.zeros(len(symbols), bool)
    hit[a[pair]] = hit[b[pair]] = True
    return [np.flatnonzero(hit[s : s + n]) for s, n in zip(begin[:-1].tolist(), lengths.tolist(), strict=True)]
