"""BK-trees over 64-bit fingerprints, grown and searched for many shards at once in numpy.

A node's children hang on edges keyed by their Hamming distance to it, one per distance. A query at distance d
of a node needs only the children on edges d - radius to d + radius. Trees are grown level by level in order of
insertion, which gives the tree that inserting one by one would.
"""

from __future__ import annotations

import numpy as np

_SPAN = 65  # distances 0 to 64
_FRONT = 1 << 20  # (query, node) pairs that are open at once


def grow(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the trees: sorted keys parent * 65 + distance, and the child of each.

    root gives each item the index of its shard's first item; an item that equals a node gets no edge.
    """
    at = np.arange(len(fp))
    active = at[root != at]
    here = root[active]
    keys, children = [], []
    while active.size:
        d = np.bitwise_count(fp[active] ^ fp[here]).astype(np.int64)
        other = d > 0
        active, key = active[other], here[other] * _SPAN + d[other]
        if not active.size:
            break
        found, first, back = np.unique(key, return_index=True, return_inverse=True)
        child = active[first]
        keys.append(found)
        children.append(child)
        here = child[back]
        deeper = here != active
        active, here = active[deeper], here[deeper]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys, kind="stable")
    return keys[order], children[order]


def search(fp: np.ndarray, root: np.ndarray, radius: int):
    """Yields arrays (item, earlier item) of all pairs of a shard within the radius, in pieces."""
    keys, children = grow(fp, root)
    at = np.arange(len(fp))
    ask = at[root != at]
    stack = [(ask[i : i + _FRONT], root[ask[i : i + _FRONT]]) for i in range(0, len(ask), _FRONT)]
    while stack:
        q, node = stack.pop()
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        near = d <= radius
        if near.any():
            yield q[near], node[near]
        low = np.searchsorted(keys, node * _SPAN + np.maximum(d - radius, 1), "left")
        n = np.searchsorted(keys, node * _SPAN + np.minimum(d + radius, 64), "right") - low
        ends = np.cumsum(n)
        cut = 0
        while cut < len(q):  # pieces of at most _FRONT, and of one pair at least
            done = ends[cut - 1] if cut else 0
            to = max(cut + 1, int(np.searchsorted(ends, done + _FRONT, "right")))
            m = n[cut:to]
            total = int(m.sum())
            if total:
                step = np.arange(total) - np.repeat(np.cumsum(m) - m, m)
                kids = children[np.repeat(low[cut:to], m) + step]
                asks = np.repeat(q[cut:to], m)
                older = kids < asks  # what hangs below a later node was inserted later still
                if older.any():
                    stack.append((asks[older], kids[older]))
            cut = to


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (the least index of each item's group so far) after linking a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def groups(fp: np.ndarray, root: np.ndarray, radius: int) -> np.ndarray:
    """The least index of each item's connected group, links being pairs of a shard within the radius."""
    label = np.arange(len(fp))
    for q, node in search(fp, root, radius):
        label = join(label, q, node)
    return label
