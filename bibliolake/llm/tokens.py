"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Fixed value: how byte-level BPE cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose counts a task remembers, and code points that are merged at a time.
REMEMBERED, BATCH = 1 << 19, 1 << 20
#: Code points of a text that are cut into pre-tokens at a time.
PIECE = 1 << 20
NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that a vocabulary writes for each byte: printable ones for
    themselves, the others in turn from code point 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Ranked merges of symbols, in arrays that are a hash table of the pairs."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], special: Iterable[str] = ()):
        letters = byte_letters()
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocabulary[letter]
        self.base = np.int64(max(vocabulary.values()) + 1)
        pairs = [(vocabulary[a] * int(self.base) + vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)]
        # Of a pair that is listed twice the last rank counts, as in a dictionary.
        table = {key: (rank, new) for key, rank, new in pairs}
        keys = np.array(list(table), np.int64)
        self.mask = (1 << (4 * len(keys) + 4).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks, self.made = np.full(self.mask + 1, NO_RANK), np.zeros(self.mask + 1, np.int64)
        rows, slots = np.arange(len(keys)), self._slot(keys)
        while len(rows):
            # Of those that want a slot the first gets it if it is free, the others go on.
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] < 0]
            self.keys[slots[first]] = keys[rows[first]]
            left = np.ones(len(rows), bool)
            left[first] = False
            rows, slots = rows[left], (slots[left] + 1) & self.mask
        at = self._find(keys)
        self.ranks[at], self.made[at] = np.array(list(table.values()), np.int64).reshape(-1, 2).T
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    @classmethod
    def from_json(cls, content: str) -> Merges:
        """From a tokenizer file of this kind; others are refused."""
        data = json.loads(content)
        model, cut = data["model"], data["pre_tokenizer"]
        plain = model["type"] == "BPE" and cut["type"] == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        odd = data["normalizer"] or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
        if not plain or odd:
            raise ValueError("only byte-level BPE without normalizer, prefix space and dropout")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], pairs, [t["content"] for t in data["added_tokens"]])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or an empty one."""
        slots = self._slot(keys)
        found = self.keys[slots]
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            slots[on] = (slots[on] + 1) & self.mask
            found = self.keys[slots[on]]
            on = on[(found != keys[on]) & (found >= 0)]
        return slots

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._find(left * self.base + right)
        return self.ranks[at], self.made[at]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty pre-token.

        All pre-tokens lie in one array. In each round every sequence takes its pair
        of lowest rank and merges it wherever it occurs, from the left; sequences
        without a known pair leave the array.
        """
        result = np.zeros(len(tokens), np.int64)
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        while len(symbols):
            rank, made = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
            rank[:-1], made[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NO_RANK
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            result[owner[starts[done]]] = sizes[done]
            chosen = (rank == np.repeat(lowest, sizes)) & (rank != NO_RANK)
            # Of pairs that overlap, as in a run of one symbol, every second one.
            run_start = chosen & ~np.concatenate(([False], chosen[:-1]))
            places = np.arange(len(symbols))
            since = places - np.maximum.accumulate(np.where(run_start, places, 0))
            chosen &= since % 2 == 0
            symbols = np.where(chosen, made, symbols)
            stays = ~np.concatenate(([False], chosen[:-1])) & ~np.repeat(done, sizes)
            symbols, owner = symbols[stays], owner[stays]
        return result


_PATTERN = regex.compile(PATTERN)
#: A space between two characters that are none: the pattern always cuts before it.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> Counter:
    """Pieces of the text that no pre-token goes over, with how often they occur."""
    found: Counter = Counter()
    done = 0
    while done < len(text):
        cut = _CUT.search(text, done + PIECE) if len(text) - done > PIECE else None
        part = text[done : cut.start()] if cut else text[done:]
        done += len(part)
        words = part.split(" ")
        rest = Counter(words[1:])
        if any(not w or w[0].isspace() or w[-1].isspace() for w in rest) or words[0][-1:].isspace() or (rest and not words[0]):
            found.update(_CUT.split(part))
        else:
            found[words[0]] += 1
            for word, n in rest.items():
                found[" " + word] += n
    return found


class TokenCounter:
    """Counts whole texts; remembers the counts of pieces between texts."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        start, held = 0, 0
        for i, piece in enumerate(new):
            held += len(piece)
            if held >= BATCH or i == len(new) - 1:
                cut = [_PATTERN.findall(p) for p in new[start : i + 1]]
                numbers: dict[str, int] = {}
                order = [numbers.setdefault(t, len(numbers)) for tokens in cut for t in tokens]
                counts = self.merges.count([t.encode("utf-8", "replace") for t in numbers])[order]
                ends = np.cumsum([len(tokens) for tokens in cut])
                sums = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))]
                self.known.update(zip(new[start : i + 1], np.diff(sums).tolist()))
                start, held = i + 1, 0

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        bags, extra = [], []
        for text in texts:
            parts = self.merges.special.split(text) if self.merges.special else [text]
            bag = pieces(parts[0])
            for part in parts[1:]:
                bag.update(pieces(part))
            bags.append(bag)
            extra.append(len(parts) - 1)
        known = self.known
        self._learn(list(dict.fromkeys(t for bag in bags for t in bag if t not in known)))
        return [n + sum([known[t] * k for t, k in bag.items()]) for bag, n in zip(bags, extra)]


#: Code points of texts whose pre-tokens are held at a time.
HELD = 1 << 21


def token_count(merges: Merges, text: str = "text") -> Column:
    """Tokens of the whole text; 0 for null."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        counter = TokenCounter(merges)
        result: list[int] = []
        held: list[str] = []
        size = 0
        for value in texts:
            held.append(value or "")
            size += len(held[-1])
            if size >= HELD:
                result += counter.counts(held)
                held, size = [], 0
        return pd.Series(result + counter.counts(held), dtype="int64")

    return count(F.col(text))


def count_tokens(docs: DataFrame, merges: Merges, limit: int = 512, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row: bytes in UTF-8, tokens
    without added ones. Null counts as empty, which has no token; special strings
    inside a text are one token each; repeated rows get equal counts; an empty table
    gives none; other columns are not read."""
    counted = docs.select(F.col(id_column), F.octet_length(whole(text)).cast("bigint").alias("n_bytes"), token_count(merges, text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
