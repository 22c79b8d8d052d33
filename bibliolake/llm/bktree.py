"""BK-trees over 64-bit fingerprints as numpy arrays, many trees at a time.

The children of a node are keyed by their Hamming distance to it. By the triangle
inequality a search with a radius only has to follow the edges whose key differs
from the distance to the node by the radius or less.
"""

from __future__ import annotations

import numpy as np

#: Larger than any distance plus radius, so that (parent, edge) fits one number.
EDGES = 192


class Forest:
    """One tree for each run of equal ``tree`` numbers (0, 1, ... in order); its
    first value is the root. Values of one tree must be distinct."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        self.roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        waiting = np.ones(len(values), bool)
        waiting[self.roots] = False
        waiting = np.flatnonzero(waiting)
        at = self.roots[tree[waiting]]
        keys, nodes = [], []
        while len(waiting):
            # All that wait at a node came at once: the first with a distance becomes
            # the child there, the others go down to it.
            key = at * EDGES + np.bitwise_count(values[waiting] ^ values[at])
            found, first, place = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            nodes.append(waiting[first])
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            at, waiting = waiting[first][place[rest]], waiting[rest]
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.nodes = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.nodes = self.keys[order], self.nodes[order]

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a query and of a node of its tree that are within the radius."""
        query, node = np.arange(len(queries)), self.roots[tree]
        hits = []
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            hits.append((query[near], node[near]))
            base = node * EDGES
            low = np.searchsorted(self.keys, base + np.maximum(distance - radius, 0), "left")
            size = np.searchsorted(self.keys, base + distance + radius, "right") - low
            start = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(start, size)
            node = self.nodes[np.repeat(low, size) + step]
            query = np.repeat(query, size)
        return np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits])


def join_groups(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merges the groups of linked members; a group is named by its smallest member
    and ``group`` names that of each member."""
    while True:
        low = np.minimum(group[a], group[b])
        new = group.copy()
        np.minimum.at(new, group[a], low)
        np.minimum.at(new, group[b], low)
        new = new[new]
        if np.array_equal(new, group):
            return group
        group = new
