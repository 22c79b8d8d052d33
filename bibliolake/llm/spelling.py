"""Spelling variants: words of a vocabulary that differ by one letter, each with the much
more frequent word it may stand for. The pairs come from searches in FM-indexes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

from .common import id_text
from .fmindex import Index, with_first_half, with_second_half

#: Code points and occurrences that a word has at least, and how many times as frequent
#: as a word its form is at least.
SHORTEST, LEAST, TIMES = 7, 2, 10
#: Fixed value: the share of the runs that lose a code point, one in so many.
SPOILT = 31
#: Code points of a text that are read at a time, words that a task counts before it
#: sends them, code points of an index, and words that are searched at a time.
PIECE, COUNTED, CELL, ASKED = 1 << 20, 1 << 18, 1 << 17, 1 << 11
#: Code points at either end of a word that words with an equal half share.
SHARED = 3

_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _runs(text: str, shortest: int) -> Iterator[list[bytes]]:
    """Maximal runs of letters, A-Z lower-cased, some at a time. In Latin-1 every letter
    in question is one byte, and anything else but ASCII becomes a question mark."""
    pattern = re.compile(rb"[a-z\xc0-\xff]{%d,}" % shortest)
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield pattern.findall(text[start:end].encode("latin-1", "replace").lower())
        start = end


def _counted(shortest: int, spoilt: int):
    """Map task: occurrences of the words of its documents."""

    def sent(counts: Counter) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for i in range(0, len(words), 1 << 16):
            some = words[i : i + (1 << 16)]
            columns = [pa.array([w.decode("latin-1") for w in some]), pa.array([counts[w] for w in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        crc = zlib.crc32
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = crc(f"{key}:".encode())
                for runs in _runs(text or "", shortest):
                    own = Counter(runs)
                    counts.update(own)
                    for word, n in own.items():
                        h = crc(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                        if not h % spoilt:
                            place = h % len(word)
                            counts[word] -= n
                            if len(word) > shortest:
                                counts[word[:place] + word[place + 1 :]] += n
                    if len(counts) >= COUNTED:
                        yield from sent(counts)
                        counts.clear()
        yield from sent(counts)

    return run


def vocabulary(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, spoilt: int = SPOILT
) -> DataFrame:
    """``(word, n)``: words of at least ``shortest`` code points and ``least`` occurrences."""
    given = docs.select(id_text(id_column).alias("id"), F.col(text).alias("text"))
    parts = given.mapInArrow(_counted(shortest, spoilt), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Words:
    """Words of a cell as arrays."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.lengths)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)

    def index(self) -> Index:
        return Index(self.points, self.lengths)

    def asked(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words of one length, and their code points as rows."""
        order = np.argsort(self.lengths, kind="stable")
        for length in np.unique(self.lengths):
            same = order[np.searchsorted(self.lengths[order], length) : np.searchsorted(self.lengths[order], length, "right")]
            for i in range(0, len(same), ASKED):
                some = same[i : i + ASKED]
                yield some, self.points[(self.ends[some] - length)[:, None] + np.arange(length)]


def _summed(asking: _Words, held: _Words, search) -> Iterator[tuple]:
    """``(word, near words, n of the best, the best)`` for the words that have some."""
    index = held.index()
    by_word = np.empty(len(held.words), np.int64)
    by_word[sorted(range(len(held.words)), key=held.words.__getitem__)] = np.arange(len(held.words))
    for some, rows in asking.asked():
        query, found = search(index, rows)
        order = np.lexsort((by_word[found], -held.n[found], query))
        query, found = query[order], found[order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else query
        count = np.diff(np.append(first, len(query)))
        for q, f, c in zip(some[query[first]].tolist(), found[first].tolist(), count.tolist()):
            yield asking.words[q], c, int(held.n[f]), held.words[f]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce task: the units of a cell. Words of a unit share a beginning or an end; two
    parts of a split unit are searched with each other's words, small units together."""
    table = pa.Table.from_batches(list(batches))
    side, key, low, high, own, words = (table.column(c).to_pylist() for c in ("side", "key", "low", "high", "own", "word"))
    n = table.column("n").to_numpy()
    units: dict[tuple, list[int]] = {}
    for i, unit in enumerate(zip(side, key, low, high)):
        units.setdefault(unit, []).append(i)

    def pick(rows: list[int]) -> _Words:
        return _Words([words[i] for i in rows], n[rows])

    def found() -> Iterator[tuple]:
        for at, search in ((0, with_first_half), (1, with_second_half)):
            together, load = [], 0
            for (s, _, a, b), rows in units.items():
                if s != at:
                    continue
                if a == b:
                    together += rows
                    load += sum(len(words[i]) + 1 for i in rows)
                    if load >= CELL:
                        some = pick(together)
                        yield from _summed(some, some, search)
                        together, load = [], 0
                else:
                    one, two = pick([i for i in rows if own[i] == a]), pick([i for i in rows if own[i] == b])
                    if one.words and two.words:
                        yield from _summed(one, two, search)
                        yield from _summed(two, one, search)
            if together:
                some = pick(together)
                yield from _summed(some, some, search)

    kinds, names = [pa.string(), pa.int64(), pa.int64(), pa.string()], ["word", "n_near", "near_n", "near"]
    rows: list[tuple] = []
    for row in found():
        rows.append(row)
        if len(rows) == 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_searched.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """``(word, n_near, near_n, near)`` for every word of ``words (word, n)`` that another
    differs from by one code point: how many do, and the most frequent of them.

    Words with an equal first half begin alike and those with an equal second half end
    alike, so each word meets the others by its first and by its last code points. A unit
    of more than ``cell`` code points is cut into parts, and every two parts meet; small
    units share a cell. So no task holds more than a few indexes of that size, unless a
    single word is longer.
    """
    load = F.length("word") + 1
    ends = F.array(
        *[F.struct(F.lit(i).alias("side"), key.alias("key")) for i, key in enumerate((F.substring("word", 1, SHARED), F.substring("word", -SHARED, SHARED)))]
    )
    keyed = words.select("word", "n", F.explode(ends).alias("end")).select("word", "n", "end.side", "end.key")
    loads = keyed.groupBy("side", "key").agg(F.ceil(F.sum(load) / cell).alias("parts"))
    total = words.agg(F.sum(load)).first()[0] or 0
    cells = max(1, -(-4 * total // cell))
    own = F.pmod(F.xxhash64("word"), F.col("parts"))
    dealt = keyed.join(loads, ["side", "key"]).select("side", "key", "parts", "word", "n", own.alias("own"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("*", other).select(
        "side", "key", "word", "n", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("parts") == 1, F.pmod(F.xxhash64("side", "key"), F.lit(cells)))
        .otherwise(F.xxhash64("side", "key", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"),
    )
    parts = dealt.groupBy("cell").applyInArrow(_searched, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """Last of the forms of each ``(word, form)``. Every form is much more frequent than
    its word, so chains are short; each round doubles the steps that are taken."""
    roots = through_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = through_table(roots.join(after, "root", "left").select("word", "root", "beyond"), "roots")
        roots = step.select("word", F.coalesce("beyond", "root").alias("root"))
        if step.where("beyond IS NOT NULL").isEmpty():
            return roots


def variants(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, cell: int = CELL
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the vocabulary.

    A word's form is the most frequent word near it, the smallest of several, if it is
    at least ``times`` as frequent; its root is the last of the forms that follow from
    it, or the word itself. One in 31 runs, by a checksum of id and run, loses a code
    point first. Null, empty and letterless texts have no words; a null id counts as
    empty text; repeated rows count again; an empty table gives no row; other columns
    are not read. ``shortest`` is 7 at least, so that halves share their three ends.
    """
    if shortest < 2 * SHARED + 1:
        raise ValueError(f"words must have {2 * SHARED + 1} code points or more")
    words = through_table(vocabulary(docs, id_column, text, shortest, least), "words")
    near = near_words(words, cell)
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        *[F.when(F.col("near_n") >= times * F.col("n"), F.col(c)).alias(a) for c, a in (("near", "form"), ("near_n", "form_n"))],
    )
    known = through_table(known, "near")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
