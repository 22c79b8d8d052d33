"""Bidirectional FM-index over a delimited vocabulary, searched for one error.

The words stand between delimiters in one text. An interval of ranks among the sorted
suffixes stands for all places of a pattern; a second interval, among the suffixes of
the reversed text, is kept in step with it, so that a pattern can grow at both ends.
"""

from __future__ import annotations

import numpy as np

#: Codes of the end of the text and of the delimiter; letters follow.
END, GAP = 0, 1
#: States that are worked on at a time.
STATES = 1 << 13


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text with a unique smallest last code, sorted by doubling."""
    n, width = len(text), int(text.max()).bit_length()
    step = 62 // width
    padded = np.concatenate((text, np.zeros(step, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = (key << width) | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after
        step *= 2


class Index:
    """Of distinct words: the code points of all, one word after the other, and how many
    each has."""

    def __init__(self, points: np.ndarray, lengths: np.ndarray):
        self.letters, codes = np.unique(points, return_inverse=True)
        self.none = len(self.letters) + 2
        starts = np.cumsum(lengths + 1) - lengths
        text = np.full(len(points) + len(lengths) + 2, GAP, np.int64)
        text[-1] = END
        text[np.arange(len(points)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = codes + 2
        self.word_at = np.full(len(text), -1, np.int32)
        self.word_at[starts - 1] = np.arange(len(lengths))
        self.order = _suffix_order(text)
        turned = np.append(text[-2::-1], END)
        self.tables = [self._table(text, self.order), self._table(turned, _suffix_order(turned))]
        self.first = self.tables[0][-1]
        self.size = len(text)

    def _table(self, text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """At row i and column c, how many of the first i codes of the transform are
        smaller than c. One more code, which nothing has, stands for other letters."""
        codes = text[order - 1]
        less = np.zeros((len(text) + 1, self.none + 2), np.int32)
        less[np.arange(1, len(text) + 1), codes + 1] = 1
        np.cumsum(less, axis=0, out=less)
        np.cumsum(less, axis=1, out=less)
        return less

    def codes(self, points: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[place] == points, place + 2, self.none)

    def grow(self, side: int, states: tuple, code: np.ndarray) -> tuple:
        """States ``(query, interval, interval on the other side, size)`` with a code
        put before (side 0) or after (side 1) their pattern; empty ones are left out.
        The first interval belongs to the side that grows."""
        query, low, other, size = states
        table = self.tables[side]
        from_low, to_low = table[low, code], table[low, code + 1]
        from_high, to_high = table[low + size, code], table[low + size, code + 1]
        grown = (to_high - from_high) - (to_low - from_low)
        live = grown > 0
        low = self.first[code] + to_low - from_low
        other = other + from_high - from_low
        return query[live], low[live], other[live], grown[live]

    def branches(self, side: int, states: tuple, but: np.ndarray) -> tuple:
        """States with every letter put to their pattern except one code each."""
        query, low, other, size = states
        table, parts = self.tables[side], []
        for i in range(0, len(query), STATES):
            part = slice(i, i + STATES)
            below, above = table[low[part]], table[low[part] + size[part]]
            smaller = above - below
            counts = np.diff(smaller, axis=1)
            counts[:, : GAP + 1] = 0
            counts[np.arange(len(counts)), but[part]] = 0
            row, code = np.nonzero(counts)
            start = self.first[code] + below[row, code + 1] - below[row, code]
            parts.append((query[part][row], start, other[part][row] + smaller[row, code], counts[row, code]))
        return _joined(parts)


def _joined(parts: list[tuple]) -> tuple:
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _some(states: tuple, chosen: np.ndarray) -> tuple:
    return tuple(c[chosen] for c in states)


def _turned(states: tuple) -> tuple:
    query, low, other, size = states
    return query, other, low, size


def _begun(index: Index, queries: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
    codes, zero = index.codes(queries), np.zeros(len(queries), np.int64)
    whole = (np.arange(len(queries)), zero, zero, np.full(len(queries), index.size))
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    return codes, whole, none


def _gap(states: tuple) -> np.ndarray:
    return np.full(len(states[0]), GAP)


# ``queries`` below are words of one length as rows of code points. The results are numbers
# of a query and of a word of the index that differ by exactly one code inserted, deleted
# or replaced. Of a run of equal codes the last counts as the one inserted or deleted, so
# of both searches exactly one finds a pair, and once.


def with_first_half(index: Index, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose error lies in the second half of the query: the first half and the
    delimiter before it match exactly, then the pattern grows to the right."""
    length = queries.shape[1]
    half = length // 2
    codes, exact, wrong = _begun(index, queries)
    for i in range(half - 1, -1, -1):
        exact = index.grow(0, exact, codes[exact[0], i])
    exact = _turned(index.grow(0, exact, _gap(exact)))
    for i in range(half, length):
        here = codes[exact[0], i]
        changed = index.branches(1, exact, here)
        wrong = index.grow(1, _joined([wrong, changed]), codes[np.concatenate((wrong[0], changed[0])), i])
        last = np.ones(len(here), bool) if i == length - 1 else here != codes[exact[0], i + 1]
        wrong = _joined([wrong, changed, _some(exact, last)])
        exact = index.grow(1, exact, here)
    wrong = _joined([wrong, index.branches(1, exact, np.full(len(exact[0]), index.none))])
    found = index.grow(1, wrong, _gap(wrong))
    return found[0], index.word_at[index.order[found[2]]]


def with_second_half(index: Index, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose error lies in the first half of the query: the second half and the
    delimiter after it match exactly, then the pattern grows to the left."""
    length = queries.shape[1]
    half = length // 2
    codes, whole, wrong = _begun(index, queries)
    exact = _turned(whole)
    for i in range(half, length):
        exact = index.grow(1, exact, codes[exact[0], i])
    exact = _turned(index.grow(1, exact, _gap(exact)))
    for i in range(half - 1, -1, -1):
        here, after = codes[exact[0], i], codes[exact[0], i + 1]
        wrong = index.grow(0, wrong, codes[wrong[0], i])
        wrong = _joined([wrong, index.branches(0, exact, here), _some(exact, here != after)])
        exact = index.grow(0, exact, here)
        # Insertions before code i; those right before the second half are the other search's.
        wrong = _joined([wrong, index.branches(0, exact, codes[exact[0], i])])
    found = index.grow(0, wrong, _gap(wrong))
    return found[0], index.word_at[index.order[found[1]]]
