"""How far the sources of a language are apart in the terms they use.

Frequencies come from one pass over the texts: a task gathers postings in memory until
they fill their room, spills them as runs sorted by term and dealt to hash shards, and
each shard merges its runs with a heap. Terms that a source lacks all have one share
there, so the sum over all terms of two sources is a number times a constant, plus
corrections for the terms that one or both have.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliolake.sources.workspace import through_table

#: Documents of its language that a kept term is in, and terms reported for a source.
LEAST_DOCS, TOP = 10, 10
#: Occurrences that a block of postings takes before it is spilled and that are counted
#: together, bytes of a text that are read at a time, bytes of text for each shard, and
#: postings that are yielded or compared at a time.
BLOCK, CHUNK, PIECE, SHARD, ROWS = 1 << 22, 1 << 18, 1 << 20, 32 << 20, 1 << 17

#: Fixed value: a term is a run of A-Z, a-z and anything beyond the first 128 code
#: points; in bytes, after lower() of A-Z, these.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")

#: A run: terms in order, how many postings each has, and the postings one after the other.
_RUN = (
    "shard int, lang string, names array<string>, terms array<binary>, sizes array<bigint>, "
    "sources array<bigint>, counts array<bigint>, docs array<bigint>"
)
_MERGED = "lang string, term binary, term_id bigint, source string, n bigint, lang_n bigint, first boolean"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, some at a time, so that a very long text needs little memory."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield _TERM.findall(text[start:end].lower())
        start = end


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and, for each, the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


class _Postings:
    """Occurrences and documents of every term of every source, up to a spill."""

    def __init__(self, shards: int):
        self.shards = shards
        self.clear()

    def clear(self) -> None:
        #: Of each language: numbers of its terms and sources, and parts of its postings.
        self.langs: dict[str, tuple[dict, dict, list]] = {}
        self.waiting: dict[str, list[tuple[int, int, list[bytes]]]] = defaultdict(list)
        self.size, self.uncounted, self.doc = 0, 0, 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        numbers = self.langs.setdefault(lang, ({}, {}, []))[1]
        place = numbers.setdefault(source, len(numbers))
        self.doc += 1
        if len(text) <= PIECE:
            terms = _TERM.findall(text.lower())
            if terms:
                self.waiting[lang].append((self.doc, place, terms))
                self.uncounted += len(terms)
                if self.uncounted >= CHUNK:
                    self.count()
            return
        # A very long text is counted alone, by pieces; each term is in one document.
        self.count()
        vocabulary, _, parts = self.langs[lang]
        seen = np.empty(0, np.int64)
        for terms in _terms(text):
            ids, counts = self._numbered(terms, vocabulary)
            ids, counts = _summed(ids, counts)
            parts.append((ids, np.full(len(ids), place), counts, (~np.isin(ids, seen)).astype(np.int64)))
            seen = np.union1d(seen, ids)
            self.size += len(terms)

    def _numbered(self, terms: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct terms, and how often each occurs."""
        coded = pa.array(terms, pa.binary()).dictionary_encode()
        return self._numbers(coded, vocabulary), np.bincount(coded.indices, minlength=len(coded.dictionary))

    @staticmethod
    def _numbers(coded: pa.DictionaryArray, vocabulary: dict[bytes, int]) -> np.ndarray:
        known = coded.dictionary.to_pylist()
        return np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in known), np.int64, len(known))

    def count(self) -> None:
        """Turns the terms that wait into postings."""
        for lang, docs in self.waiting.items():
            vocabulary, _, parts = self.langs[lang]
            coded = pa.array([t for *_, terms in docs for t in terms], pa.binary()).dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(docs)), [len(terms) for *_, terms in docs])
            width = len(coded.dictionary)
            in_doc, counts = np.unique(doc * width + codes, return_counts=True)
            source = np.array([place for _, place, _ in docs])[in_doc // width]
            keys, counts, found = _summed(source * width + in_doc % width, counts, np.ones(len(counts), np.int64))
            parts.append((self._numbers(coded, vocabulary)[keys % width], keys // width, counts, found))
            self.size += len(codes)
        self.waiting.clear()
        self.uncounted = 0

    def spill(self) -> Iterator[pa.RecordBatch]:
        """A run for each shard and language, sorted by term and source."""
        self.count()
        for lang, (vocabulary, numbers, parts) in self.langs.items():
            if not parts:
                continue
            terms = sorted(vocabulary)
            rank = np.empty(len(terms), np.int64)
            rank[np.fromiter(map(vocabulary.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
            ids, source, counts, docs = map(np.concatenate, zip(*parts))
            parts.clear()
            keys, counts, docs = _summed(rank[ids] * len(numbers) + source, counts, docs)
            ids, source = keys // len(numbers), keys % len(numbers)
            of_term = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % self.shards
            words = np.array(terms, object)
            shard = of_term[ids]
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                rows = order[bounds[s] : bounds[s + 1]]
                own, sizes = np.unique(ids[rows], return_counts=True)
                lists = [list(numbers), words[own].tolist(), sizes, source[rows], counts[rows], docs[rows]]
                kinds = [pa.string(), pa.binary(), *[pa.int64()] * 4]
                columns = [pa.array([s], pa.int32()), pa.array([lang])] + [
                    pa.ListArray.from_arrays([0, len(c)], pa.array(c, k)) for c, k in zip(lists, kinds)
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RUN.split(", ")])
        self.clear()


def _indexed(shards: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = _Postings(shards)
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                postings.add(lang, source, text)
                if postings.size >= block:
                    yield from postings.spill()
        yield from postings.spill()

    return run


def _merge(runs: list[dict]) -> tuple[list[bytes], np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All terms of some runs in order, and the postings as ``(number of the term, number
    of the source, occurrences, documents)``; a heap goes through the terms of all runs."""
    terms: list[bytes] = []
    places = [np.empty(len(run["terms"]), np.int64) for run in runs]
    at = [0] * len(runs)
    for term, run in heapq.merge(*(zip(r["terms"], repeat(i)) for i, r in enumerate(runs))):
        if not terms or terms[-1] != term:
            terms.append(term)
        places[run][at[run]] = len(terms) - 1
        at[run] += 1
    names: dict[str, int] = {}
    sources = [np.array([names.setdefault(n, len(names)) for n in r["names"]])[r["sources"]] for r in runs]
    term = np.concatenate([np.repeat(p, r["sizes"]) for p, r in zip(places, runs)])
    counts, docs = (np.concatenate([r[c] for r in runs]) for c in ("counts", "docs"))
    keys, counts, docs = _summed(term * len(names) + np.concatenate(sources), counts, docs)
    return terms, keys // len(names), list(names), keys % len(names), counts, docs


def _merged(least_docs: int, shards: int):
    """Reduce task: the frequencies of the terms of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, shard = defaultdict(list), 0
        for batch in batches:
            shard = batch.column("shard")[0].as_py()
            numbers = [batch.column(c) for c in ("sizes", "sources", "counts", "docs")]
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                known = {c: batch.column(c)[i].as_py() for c in ("names", "terms")}
                runs[lang].append(known | {c: v[i].values.to_numpy() for c, v in zip(("sizes", "sources", "counts", "docs"), numbers)})
        for lang in sorted(runs):
            terms, term, names, source, counts, docs = _merge(runs.pop(lang))
            kept = np.bincount(term, docs, len(terms)) >= least_docs
            totals = np.zeros(len(terms), np.int64)
            np.add.at(totals, term, counts)
            first = np.concatenate(([True], term[1:] != term[:-1]))
            rows = np.flatnonzero(kept[term])
            words, names = pa.array(terms, pa.binary()), pa.array(names)
            for i in range(0, len(rows), ROWS):
                r = rows[i : i + ROWS]
                columns = [
                    pa.array([lang] * len(r)), words.take(pa.array(term[r])), pa.array(term[r] * shards + shard), names.take(pa.array(source[r])),
                    pa.array(counts[r]), pa.array(totals[term[r]]), pa.array(first[r]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _MERGED.split(", ")])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _given(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data"),
    )


def frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, term, term_id, source, n, lang_n, first)``: occurrences of every kept term
    in the sources that have it and in the language; a number for each term of a language;
    ``first`` marks one row of each term."""
    given = _given(docs, text, lang, source)
    size = given.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))
    runs = given.select("lang", "source", "data").mapInArrow(_indexed(shards, BLOCK), _RUN)
    merged = runs.groupBy("shard").applyInArrow(_merged(least_docs, shards), _MERGED)
    return merged.withColumn("term", F.col("term").cast("string"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)); decimals where 64 bits do not do."""
    below = total + terms * 2
    wide = F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + 2)
    share = F.when(n < 9_000_000_000, F.call_function("div", (n + 2) * 1_000_000_000, below)).otherwise(
        F.call_function("div", wide, below.cast("decimal(20,0)"))
    )
    return F.when(terms > 0, 1 + share)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart_numpy(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for the terms that two sources have, summed for each two sources.

    The postings of a term are compared with those 1, 2, ... places after them, many
    terms at a time, and only sums leave the task."""
    # A cell has one language. Its rows are all postings of some terms.
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    langs = table.column("lang").to_pylist()[:1]
    coded = table.column("source").combine_chunks().dictionary_encode()
    names, source, term = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), table.column("term_id").to_numpy()
    order = np.lexsort((source, term))
    term, source = term[order], source[order]
    p, p0 = (table.column(c).to_numpy()[order] for c in ("p", "p0"))
    sums: dict[int, int] = defaultdict(int)
    step = 1
    while True:
        same = np.flatnonzero(term[step:] == term[:-step])
        if not len(same):
            break
        for i in range(0, len(same), ROWS):
            a = same[i : i + ROWS]
            b = a + step
            value = _apart_numpy(p[a], p[b]) - _apart_numpy(p[a], p0[b]) - _apart_numpy(p0[a], p[b]) + _apart_numpy(p0[a], p0[b])
            low, high = np.minimum(source[a], source[b]), np.maximum(source[a], source[b])
            code, total = _summed(low * len(names) + high, value)
            for c, v in zip(code.tolist(), total.tolist()):
                sums[c] += v
        step += 1
    codes = list(sums)
    for i in range(0, len(codes), ROWS):
        some = codes[i : i + ROWS]
        columns = [langs * len(some), [names[c // len(names)] for c in some], [names[c % len(names)] for c in some], [sums[c] for c in some]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.string(), pa.int64()])], ["lang", "source", "other", "value"]
        )


_both.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``. Part ``pair`` has every other source
    of the language with the distance of the two over all kept terms, part ``term`` the
    ``top`` kept terms that the source has a larger share of than its language.

    Null text, language and source count as empty; a language without a kept term has
    distances 0; a source without terms has the share of absent terms for all of them;
    ties go to the smaller item; repeated rows are documents of their own; an empty table
    gives no row; other columns are not read.
    """
    freq = through_table(frequencies(docs, least_docs, text, lang, source), "frequencies")
    groups = _given(docs, text, lang, source).select("lang", "source").distinct()
    of_source = freq.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = freq.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    zero = F.lit(0).cast("bigint")
    shares = groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms")]
    )
    shares = through_table(shares.withColumn("p0", _share(zero, F.col("total"), F.col("terms"))), "sources")
    rows = freq.join(shares, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))

    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = rows.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    other = shares.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    pairs = shares.select("lang", "source", "p0", "terms").join(other, "lang").where("source <> other")
    base = _apart(F.col("p0"), F.col("q0"))
    # Sources repeat few numbers of occurrences, so their terms are counted by share.
    alike = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    one = pairs.join(alike, ["lang", "source"]).groupBy("lang", "source", "other").agg(
        F.sum(F.col("times") * (_apart(F.col("p"), F.col("q0")) - base)).alias("value")
    )
    cells = max(1, -(-freq.count() // ROWS))
    cell = F.pmod(F.xxhash64("term_id"), F.lit(cells))
    two = rows.select("lang", "source", "term_id", "p", "p0", cell.alias("cell")).groupBy("lang", "cell").applyInArrow(
        _both, "lang string, source string, other string, value bigint"
    )
    corrections = one.unionByName(two)
    turned = corrections.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    start = pairs.select("lang", "source", "other", F.coalesce(F.col("terms") * base, zero).alias("value"))
    summed = start.unionByName(corrections).unionByName(turned).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pair_part = summed.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pair_part.withColumn("part", F.lit("pair")).select(*columns).unionByName(term_part.withColumn("part", F.lit("term")).select(*columns))
    )


#: Every kept term meets every source; only for small tables.
SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
tf AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
k AS (SELECT lang, source, term, n FROM tf JOIN df USING (lang, term)),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
tot AS (SELECT g.lang, g.source, coalesce(sum(k.n), 0) AS total, any_value(v.v) AS v
  FROM g JOIN v USING (lang) LEFT JOIN k USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT t.lang, t.source, df.term, coalesce(k.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(k.n, 0) + 2) // (t.total + 2 * t.v)::HUGEINT AS p
  FROM tot t JOIN df ON t.lang = df.lang LEFT JOIN k ON k.lang = t.lang AND k.source = t.source AND k.term = df.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 2) // (any_value(lt)::HUGEINT + 2 * any_value(v)) AS q
  FROM p JOIN (SELECT lang, sum(total) AS lt, any_value(v) AS v FROM tot GROUP BY lang) USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10
"""
