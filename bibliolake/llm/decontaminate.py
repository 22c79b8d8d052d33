"""Benchmark decontamination by templates: numbers, names and units become typed
placeholders, windows of the templates are joined by hash, and the values of the
placeholders must fit together, so that a question asked with other numbers or names
is found too."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

from . import chars

#: Tokens of a window, and the share of an item's windows that a document must hold.
WINDOW, COVERAGE = 5, 0.8
#: A window must have so many tokens that are no placeholders.
LITERALS = 2
#: Bits of the filter that goes to all tasks, whatever the size of the benchmark.
FILTER_BITS = 1 << 23
#: Code points of a text that are worked on at a time.
PIECE = 1 << 18

#: Units that count as one placeholder, in lower case.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs ms kb mb gb tb w kw v hz usd eur gbp percent "
    "meter meters metre metres kilometer kilometers kilogram kilograms gram grams liter liters litre litres second seconds "
    "minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents mile miles "
    "inch inches foot feet".split()
)
_SPACE = re.compile(r"\s")
#: Classes of characters, also by their flags and below 64 those that end a sentence.
OTHER, LETTER, DIGIT, STOP = range(4)
_KINDS = np.array([DIGIT if f & chars.DECIMAL else LETTER if f & (chars.ALPHA | chars.OTHER_ALNUM) else OTHER for f in range(32)], np.int8)
_STOPS = np.array([STOP if chr(i) in ".!?:\n\r" else OTHER for i in range(64)], np.int8)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D626572, 0x6E616D65, 0x756E6974))


class Tokens:
    """Tokens of a piece of text as arrays: first character, end, hash of the lower
    case, class, and whether it is a word with one capital, at its start.

    Tokens are runs of letters, numbers with points and commas inside, and runs of
    characters that end a sentence.
    """

    def __init__(self, text: str):
        codes = chars.code_points(text)
        flags = chars.flags(codes)
        kind = np.zeros(len(codes) + 2, np.int8)
        inner = kind[1:-1]
        inner[:] = _KINDS[flags]
        low = np.flatnonzero((codes < 64) & (inner == OTHER))
        inner[low] = _STOPS[codes[low]]
        between = ((codes == 46) | (codes == 44)) & (kind[:-2] == DIGIT) & (kind[2:] == DIGIT)
        inner[between] = DIGIT
        self.start = np.flatnonzero((inner != OTHER) & (inner != kind[:-2]))
        self.end = np.flatnonzero((inner != OTHER) & (inner != kind[2:])) + 1
        self.kind = inner[self.start]
        if not len(self.start):
            self.hash, self.capital = np.empty(0, np.uint64), np.empty(0, bool)
            return
        sizes = self.end - self.start
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(first, sizes)
        at = place + np.repeat(self.start, sizes)
        code = codes[at]
        mixed = (chars.lowered(code).astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24))) * _K1
        mixed ^= mixed >> np.uint64(29)
        mixed *= _K2
        self.hash = np.add.reduceat(mixed, first)
        flags = flags[at]
        upper, lower = flags & chars.UPPER > 0, flags & chars.LOWER > 0
        self.capital = upper[first] & (np.add.reduceat(upper, first, dtype=np.int64) == 1) & np.logical_or.reduceat(lower, first)


def _unit_hashes() -> np.ndarray:
    return np.sort(Tokens(" ".join(sorted(UNITS))).hash)


class Templates:
    """The templates of whole texts: a hash for each token that ends no sentence and
    whether it is a placeholder. Placeholders are numbers, units right after a number,
    and names: words with one capital, at their start, where no sentence begins. Such a
    word that begins a sentence may be a name or not, so it has both readings."""

    def __init__(self, texts: list[str], units: np.ndarray):
        # A line end between texts begins a sentence and parts numbers from units.
        self.text = "\n".join(texts)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        hashes, slots, initial, spans = [np.empty(0, np.uint64)], [np.empty(0, bool)], [np.empty(0, bool)], [np.empty((2, 0), np.int64)]
        starts, after_number, done = True, False, 0
        while done < len(self.text):
            cut = _SPACE.search(self.text, done + PIECE)
            end = cut.end() if cut else len(self.text)
            t = Tokens(self.text[done:end])
            if len(t.start):
                number, stop = t.kind == DIGIT, t.kind == STOP
                unit = np.concatenate(([after_number], number[:-1])) & (t.kind == LETTER)
                unit[unit] = np.isin(t.hash[unit], units)
                begin, word = np.concatenate(([starts], stop[:-1])), t.capital & ~unit
                name = word & ~begin
                t.hash[number], t.hash[unit], t.hash[name] = _NUMBER, _UNIT, _NAME
                starts, after_number = bool(stop[-1]), bool(number[-1])
                kept = ~stop
                hashes.append(t.hash[kept])
                slots.append((number | unit | name)[kept])
                initial.append((word & begin)[kept])
                spans.append(np.stack((t.start, t.end))[:, kept] + done)
            done = end
        self.hashes, self.slots, self.spans = np.concatenate(hashes), np.concatenate(slots), np.concatenate(spans, axis=1)
        self.initial = np.concatenate(initial)
        self.owner = np.searchsorted(begins, self.spans[0], "right") - 1
        self.first = np.searchsorted(self.owner, np.arange(len(texts)))
        self.sizes = np.bincount(self.owner, minlength=len(texts))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens at which a window with enough plain words begins, in order, and the
        windows' hashes. A text with fewer tokens than a window is one window."""
        found = [self._windows(WINDOW, np.flatnonzero(self.sizes >= WINDOW))]
        for size in range(1, WINDOW):
            short = np.flatnonzero(self.sizes == size)
            if len(short):
                found.append(self._windows(size, short))
        places = np.concatenate([p for p, _ in found])
        order = np.argsort(places, kind="stable")
        return places[order], np.concatenate([h for _, h in found])[order]

    def renamed(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for whole windows with a word that begins a sentence, which is read
        as a name."""
        count = max(len(self.hashes) - WINDOW + 1, 0)
        near = np.flatnonzero(self.initial)[:, None] - np.arange(WINDOW)
        places = np.unique(near[(near >= 0) & (near < count)])
        places = places[self.owner[places] == self.owner[places + WINDOW - 1]]
        return self._hashed(WINDOW, places, np.where(self.initial, _NAME, self.hashes), self.slots | self.initial)

    def _windows(self, size: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = max(len(self.hashes) - size + 1, 0)
        if size < WINDOW:
            places = self.first[texts]
        else:
            places = np.flatnonzero(self.owner[:count] == self.owner[size - 1 : size - 1 + count])
        return self._hashed(size, places, self.hashes, self.slots)

    @staticmethod
    def _hashed(size: int, places: np.ndarray, hashes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.full(len(places), size, np.uint64)
        plain = np.zeros(len(places), np.int8)
        for i in range(size):
            h = (h ^ hashes[places + i]) * _K1
            h ^= h >> np.uint64(29)
            plain += ~slots[places + i]
        enough = plain >= min(LITERALS, size)
        return places[enough], h[enough].view(np.int64)

    def values(self, place: int, renamed: bool = False) -> list[str]:
        """What the placeholders of the window at a token stand for, in order."""
        size = min(WINDOW, int(self.sizes[self.owner[place]]))
        window = slice(place, place + size)
        slots = self.slots[window] | self.initial[window] if renamed else self.slots[window]
        return [self.text[a:b].lower() for a, b in self.spans[:, window][:, slots].T.tolist()]


def _blocks(texts: list[str]):
    """Ranges of texts that together, or alone, are about a piece long."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= PIECE or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _rows(keep: np.ndarray | None):
    """Rows of the windows of texts; of texts to search, those that pass the filter."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = _unit_hashes()
        for batch in batches:
            keys, texts = batch["key"].tolist(), [t or "" for t in batch["text"]]
            found = []
            for begin, end in _blocks(texts):
                t = Templates(texts[begin:end], units)
                places, hashes = t.windows()
                of = t.owner[places]
                totals = np.bincount(of, minlength=end - begin)
                # Second readings of windows that are counted already.
                again, more = t.renamed()
                second = np.repeat([False, True], [len(places), len(again)])
                places, hashes = np.concatenate((places, again)), np.concatenate((hashes, more))
                of = t.owner[places]
                if keep is not None:
                    slot = hashes & (FILTER_BITS - 1)
                    some = np.flatnonzero(keep[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    places, hashes, of, second = places[some], hashes[some], of[some], second[some]
                near = places - t.first[of]
                for place, i, at, h, renamed in zip(places.tolist(), of.tolist(), near.tolist(), hashes.tolist(), second.tolist()):
                    found.append((keys[begin + i], at, h, t.values(place, renamed), renamed, int(totals[i])))
            yield pd.DataFrame(found, columns=["key", "place", "hash", "slots", "renamed", "n_windows"])

    return rows


def windows(texts: DataFrame, keep: np.ndarray | None = None) -> DataFrame:
    """Windows of ``texts (key string, text)``; all, or those that pass a filter."""
    return texts.mapInPandas(_rows(keep), "key string, place bigint, hash bigint, slots array<string>, renamed boolean, n_windows bigint")


def window_filter(items: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of windows. Its size is fixed; for a large benchmark it
    lets more through, never less, and the join decides."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    slots = items.select(F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")).distinct()
    for row in slots.toLocalIterator():
        bits[row["slot"] >> 3] |= 1 << (row["slot"] & 7)
    return bits


def text_key(text: str = "text") -> Column:
    """Equal texts hold the same windows, so a text is known by its digest."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item_id, windows, n_windows, coverage, reparameterised)``: texts, known
    by their digest, that hold at least ``COVERAGE`` of an item's windows.

    Windows on one diagonal (place in the text less place in the item) are one
    reading of the item; its placeholders are consistent if each value of the item
    always meets the same value of the text and the other way round. Windows with
    placeholders count on consistent diagonals only, others always. A word that begins
    a sentence is read as it is and as a name: windows without such names count if they
    are consistent among themselves, those with such names if all windows are.
    """
    numbered = items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("item_text")).distinct()
    narrow = numbered.select(text_key("item_text").alias("key"), F.col("item_text").alias("text")).dropDuplicates(["key"])
    of_items = through_table(windows(narrow), "item-windows")
    keep = window_filter(of_items)
    texts = docs.where(F.col(text).isNotNull()).select(text_key(text).alias("key"), F.col(text).alias("text"))
    # Copies of a text give equal rows, which the distinct below brings together.
    found = windows(texts, keep).select("key", "place", "hash", "slots", "renamed").distinct()
    asked = of_items.select(F.col("key").alias("item_key"), F.col("place").alias("item_place"), "hash", F.col("slots").alias("item_slots"), F.col("renamed").alias("item_renamed"))
    met = found.join(asked, "hash").select(
        "key", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place",
        F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("text")).alias("pairs"), (F.col("renamed") | F.col("item_renamed")).alias("renamed"),
    )
    # An item has few windows, and on a diagonal each meets one place in two readings.
    reading = met.groupBy("key", "item_key", "diagonal").agg(
        F.collect_list(F.struct("item_place", (F.size("pairs") == 0).alias("plain"), "renamed")).alias("met"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("all"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("renamed"), F.col("pairs"))))).alias("strict"),
    )

    def one_to_one(pairs: str) -> Column:
        return (F.size(pairs) == F.size(F.array_distinct(f"{pairs}.item"))) & (F.size(pairs) == F.size(F.array_distinct(f"{pairs}.text")))

    def changed(pairs: str) -> Column:
        return F.exists(pairs, lambda p: p["item"] != p["text"])

    counted = (
        reading.withColumn("fits", one_to_one("all")).withColumn("strictly", one_to_one("strict"))
        .select("key", "item_key", ((F.col("fits") & changed("all")) | (F.col("strictly") & changed("strict"))).alias("changed"), "fits", "strictly", F.explode("met").alias("m"))
        .where("m.plain or fits or (strictly and not m.renamed)")
        .groupBy("key", "item_key", "m.item_place")
        .agg(F.max("changed").alias("changed"))
    )
    total = of_items.groupBy(F.col("key").alias("item_key")).agg(F.max("n_windows").alias("n_windows"))
    held = counted.groupBy("key", "item_key").agg(F.count("*").alias("windows"), F.max("changed").alias("reparameterised"))
    enough = held.join(total, "item_key").withColumn("coverage", F.col("windows") / F.col("n_windows")).where(F.col("coverage") >= COVERAGE)
    named = numbered.select(text_key("item_text").alias("item_key"), "item_id")
    return enough.join(named, "item_key").select("key", "item_id", "windows", "n_windows", "coverage", "reparameterised")


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, item_id, windows, n_windows, coverage, reparameterised)`` for every row
    of ``docs`` and every item it holds. Null and empty texts hold nothing; items
    without a window with enough plain words cannot be found; repeated rows are
    listed as often as they are given; either table may be empty."""
    found = leaks(docs, items, text, item_column, item_text)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("__id"), text_key(text).alias("key"))
    return rows.join(found, "key").select(F.col("__id").alias(id_column), *found.columns[1:])


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text holds no item."""
    found = leaks(docs, items, text, item_column, item_text).select(F.col("key").alias("__key")).distinct()
    kept = docs.withColumn("__key", text_key(text)).join(found, "__key", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
