"""Removal of word sequences that an earlier document has already.

Rabin-Karp hashes of every window of a fixed number of words are counted in Spark;
the repeated windows of a document merge into maximal intervals, which are cut.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliolake.sources.workspace import new_path

#: Words of a window.
WINDOW = 13
#: Odd bases of the rolling hashes over the bytes of a word and over words.
BYTE_BASE, WORD_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Bytes that are hashed at a time, windows that a task sorts at a time, and bytes
#: of text for each shard of the hashes and for each bucket of documents.
PIECE, BLOCK, SHARD, BUCKET = 1 << 20, 1 << 20, 6 << 20, 24 << 20
#: Bytes of texts whose words are looked at together.
CHUNK = 1 << 21
#: Stands for a missing id, which is smaller than any other.
NO_ID = -(1 << 63)

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: dict[int, np.ndarray] = {}
#: What a map task sends to a shard: windows whose document may not be the first, and
#: the windows of which the task already knows an earlier document.
_SENT = (
    "shard int, hash binary, check binary, at binary, id binary, tag binary, size binary, "
    "known_id binary, known_tag binary, known_at binary"
)
#: What a shard sends to the buckets of the documents, and what these give.
_HITS = "bucket int, id binary, tag binary, at binary"
_FOUND = "id bigint, tag bigint, spans array<int>"


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _powers(base: int, size: int) -> np.ndarray:
    """The first powers of a base modulo 2^64; kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        known = np.full(max(size, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _POWERS[base] = np.cumprod(known, dtype=np.uint64)
    return known[:size]


def _rolled(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of every span of the values, from the sums of its two ends."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(_inverse(base), len(values) + 1)[starts]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits, so that sums of words have no structure left."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces that end where a word ends."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield data[start:end]
        start = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins in the bytes, and its hash."""
    places, hashes, done = [], [], 0
    for piece in _pieces(data, PIECE):
        codes = np.frombuffer(piece, np.uint8)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = (codes != 32) & ((codes < 9) | (codes > 13))
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        hashes.append(_mixed(_rolled(codes.astype(np.uint64) + np.uint64(1), BYTE_BASE, starts, ends)))
        places.append(starts + done)
        done += len(piece)
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of 64 bits and a second one of 16 bits for every window of the words."""
    starts = np.arange(max(len(words) - window + 1, 0))
    second = _rolled(_mixed(words + np.uint64(WORD_BASE)), CHECK_BASE, starts, starts + window)
    return _rolled(words, WORD_BASE, starts, starts + window), (second >> np.uint64(48)).astype(np.uint16)


def _planes(values: np.ndarray) -> bytes:
    """Differences as bytes, lowest of all first: small ones leave runs of zeros, which
    the compression of the shuffle removes."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def _from_planes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that agree in all columns begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _grouped(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and where each group begins."""
    order = np.argsort(hashes)
    h, g = hashes[order], checks[order]
    if np.any((h[1:] == h[:-1]) & (g[1:] != g[:-1])):
        order = np.lexsort((checks, hashes))
        h, g = hashes[order], checks[order]
    return order, _runs(h, g)


def _after_the_first(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id than the row's has the same window."""
    order, starts = _grouped(hashes, checks)
    least = np.minimum.reduceat(ids[order], starts) if len(order) else ids
    later = np.empty(len(ids), bool)
    later[order] = ids[order] > np.repeat(least, np.diff(np.append(starts, len(order))))
    return later


class _Block:
    """Windows of some documents, in the order of the documents and words."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.size = shards, [], 0
        self.seen: set[tuple[int, int]] = set()

    def new(self, doc: int, data: bytes) -> bool:
        """Whether the block has no such row yet; a repeated row adds nothing."""
        size = len(self.seen)
        self.seen.add((doc, _tag(data)))
        return len(self.seen) > size

    def add(self, ids: np.ndarray, tags: np.ndarray, at: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> None:
        self.parts.append((ids, tags, at, hashes, checks))
        self.size += len(ids)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids, tags, at, hashes, checks = map(np.concatenate, zip(*self.parts))
        self.parts, self.size = [], 0
        self.seen.clear()
        later = _after_the_first(hashes, checks, ids)
        known = (_planes(ids[later]), _planes(tags[later]), _planes(at[later]))
        known_to = int(zlib.crc32(known[0] + known[2]) % self.shards)
        # Of a window that many documents of the block have, the first alone goes on.
        keep = ~later
        shard = (((hashes[keep] >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)).astype(
            np.uint16 if self.shards <= 1 << 16 else np.uint32
        )
        order = np.argsort(shard, kind="stable")
        shard, columns = shard[order], [c[keep][order] for c in (hashes, checks, at, ids, tags)]
        bounds = np.append(_runs(shard), len(shard))
        rows = []
        for i, j in zip(bounds[:-1], bounds[1:]):
            h, g, place, doc, tag = (c[i:j] for c in columns)
            first = _runs(doc, tag)
            size = np.diff(np.append(first, j - i)).astype(np.uint32)
            sent = (h.tobytes(), g.tobytes(), _planes(place), _planes(doc[first]), _planes(tag[first]), _planes(size))
            rows.append((int(shard[i]), *sent, b"", b"", b""))
        if len(known[0]):
            rows.append((known_to, b"", b"", b"", b"", b"", b"", *known))
        schema = pa.schema([("shard", pa.int32())] + [(c.split()[0], pa.binary()) for c in _SENT.split(", ")[1:]])
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256]), schema.types)], schema=schema)


def _tag(data: bytes) -> int:
    """Tells texts under one id apart."""
    return zlib.crc32(data)


def _windows(window: int, shards: int, block: int):
    """Map task: windows of all its documents, sorted in blocks and sent to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Block(shards)

        def take(chunk: list[tuple[int, bytes]]) -> None:
            starts, words = word_hashes(b"\n".join(data for _, data in chunk))
            sizes = np.array([len(data) + 1 for _, data in chunk])
            doc = np.searchsorted(np.cumsum(sizes), starts, "right")
            hashes, checks = window_hashes(words, window)
            first = doc[: len(hashes)]
            inside = np.flatnonzero(first == doc[window - 1 :][: len(hashes)])
            first = first[inside]
            at = inside - np.searchsorted(doc, np.arange(len(chunk)))[first]
            ids = np.array([i for i, _ in chunk], np.int64)
            tags = np.array([_tag(data) for _, data in chunk], np.uint32)
            found.add(ids[first], tags[first], at.astype(np.uint32), hashes[inside], checks[inside])

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_pylist()
            chunk, size = [], 0
            for i, data in zip(ids, batch.column(1).to_pylist()):
                if not data or not found.new(i, data):
                    continue
                chunk.append((i, data))
                size += len(data)
                if size >= CHUNK:
                    take(chunk)
                    chunk, size = [], 0
                    if found.size >= block:
                        yield from found.rows()
            if chunk:
                take(chunk)
                if found.size >= block:
                    yield from found.rows()
        yield from found.rows()

    return run


def _judged(buckets: int):
    """Reduce task: the windows of one shard that a smaller id has too, dealt to buckets
    by id; so the rows that leave it do not grow with the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known = [], []
        for batch in batches:
            for row in batch.drop_columns(["shard"]).to_pylist():
                if row["known_id"]:
                    places = (_from_planes(row[f"known_{c}"], t) for c, t in (("id", np.int64), ("tag", np.uint32), ("at", np.uint32)))
                    known.append(tuple(places))
                if row["hash"]:
                    size = _from_planes(row["size"], np.uint32)
                    docs = np.repeat(_from_planes(row["id"], np.int64), size), np.repeat(_from_planes(row["tag"], np.uint32), size)
                    hashes, checks = np.frombuffer(row["hash"], np.uint64), np.frombuffer(row["check"], np.uint16)
                    parts.append((hashes, checks, *docs, _from_planes(row["at"], np.uint32)))
        if parts:
            hashes, checks, ids, tags, at = map(np.concatenate, zip(*parts))
            del parts
            later = _after_the_first(hashes, checks, ids)
            known.append((ids[later], tags[later], at[later]))
            del hashes, checks, ids, tags, at
        for some in known:
            bucket = (_mixed(some[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bounds = np.append(_runs(bucket[order]), len(order))
            for i, j in zip(bounds[:-1], bounds[1:]):
                columns = [[int(bucket[order[i]])], *([_planes(c[order[i:j]])] for c in some)]
                names = [c.split()[0] for c in _HITS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.binary()] * 3])], names)

    # The hints tell Spark that the function goes through the batches of a group.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _gathered(window: int):
    """Reduce task: a row for each document of a bucket, with the intervals of words that
    its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for row in batch.drop_columns(["bucket"]).to_pylist():
                parts.append(tuple(_from_planes(row[c], t) for c, t in (("id", np.int64), ("tag", np.uint32), ("at", np.uint32))))
        ids, tags, at = map(np.concatenate, zip(*parts))
        del parts
        order = np.lexsort((at, tags, ids))
        ids, tags, at = ids[order], tags[order], at[order].astype(np.int64)
        doc = np.zeros(len(ids), bool)
        doc[_runs(ids, tags)] = True
        new = doc.copy()
        new[1:] |= at[1:] > at[:-1] + window
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(at)) - 1
        spans = np.stack((at[starts], at[ends] + window), axis=1).ravel().astype(np.int32)
        first = np.flatnonzero(doc[starts])
        offsets = np.append(first, len(starts)).astype(np.int32) * 2
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(spans))
        where = starts[first]
        result = pa.RecordBatch.from_arrays([pa.array(ids[where]), pa.array(tags[where].astype(np.int64)), lists], ["id", "tag", "spans"])
        for i in range(0, len(result), 10_000):
            yield result.slice(i, 10_000)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _cut(data: bytes, spans: np.ndarray | None) -> tuple[int, int, list[bytes]]:
    """Words of a text, how many of them the intervals cover, and the pieces that are
    left, each the kept words joined by one space."""
    if spans is None or not len(spans):
        n, kept = 0, []
        for piece in _pieces(data, PIECE):
            words = piece.split()
            n += len(words)
            kept += [b" ".join(words)] if words else []
        return n, 0, kept
    gone = np.zeros(int(spans[-1]), bool)
    for start, end in spans.reshape(-1, 2).tolist():
        gone[start:end] = True
    n, kept = 0, []
    for piece in _pieces(data, PIECE):
        words = piece.split()
        lost = gone[n : n + len(words)].tolist()
        left = [w for w, g in zip(words, lost) if not g] + words[len(lost) :]
        n += len(words)
        kept += [b" ".join(left)] if left else []
    return n, int(gone.sum()), kept


def repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, tag, spans)`` of the documents with words to remove: the crc32 of the text
    and the intervals ``[from, to, from, to, ...]`` of its words that are covered by a
    window which also starts in a document with a smaller id. Intervals may overlap.

    A task sorts its windows by hash, so a window that very many documents have leaves
    it once; what it knows to be repeated goes on as intervals. The rest meets in shards
    by hash, whose number grows with the bytes of all texts, 80 bits of hash deciding.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("binary").alias("data"))
    size = given.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards, buckets = (max(1, -(-size // each)) for each in (SHARD, BUCKET))
    sent = given.mapInArrow(_windows(window, shards, BLOCK), _SENT)
    hits = sent.groupBy("shard").applyInArrow(_judged(buckets), _HITS)
    found = hits.groupBy("bucket").applyInArrow(_gathered(window), _FOUND)
    where = new_path(spark, "repeated")
    # The windows are many times the intervals; once these are written, nothing needs
    # the files of their shuffle.
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        found.write.parquet(where)
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(where)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of every row: its words, those covered by a
    window of ``window`` words that also starts in a document with a smaller id, and the
    others joined by one space.

    Windows are judged on the input. Null, empty and blank texts have no words; texts
    shorter than a window lose none; ids are integers, a null id is smaller than all and
    rows with equal ids remove nothing from each other; repeated rows appear as often as
    they are given; an empty table gives none; other columns are not read.
    """
    return _cut_rows(docs, id_column, text, window, "kept binary").withColumn("kept", F.col("kept").cast("string"))


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """As ``without_repeats``, with the SHA-256 of the kept words in their place."""
    return _cut_rows(docs, id_column, text, window, "kept_sha256 string")


def _cut_rows(docs: DataFrame, id_column: str, text: str, window: int, kept: str) -> DataFrame:
    given = docs.select(F.col(id_column).alias("id"), F.col(text).cast("binary").alias("data"))
    given = given.withColumn("key", F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)))
    given = given.withColumn("tag", F.crc32(F.coalesce("data", F.lit(b""))))
    spans = repeated(docs, id_column, text, window).select(F.col("id").alias("key"), "tag", "spans")
    as_digest = kept.startswith("kept_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, results = [], []
            for data, lost in zip(batch.column("data").to_pylist(), batch.column("spans")):
                lost = np.asarray(lost.values.to_numpy(zero_copy_only=False)) if lost.is_valid else None
                n, removed, pieces = _cut(data or b"", lost)
                counts.append((n, removed))
                if as_digest:
                    digest = hashlib.sha256()
                    for i, piece in enumerate(pieces):
                        digest.update(b" " + piece if i else piece)
                    results.append(digest.hexdigest())
                else:
                    results.append(b" ".join(pieces))
            columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(results)]
            if counts:
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", kept.split()[0]])

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    joined = given.join(spans, ["key", "tag"], "left").select("id", "data", "spans")
    return joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, {kept}").withColumnRenamed("id", id_column)


#: Windows as texts, each with the smallest id that has it.
SQL = """
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), firsts AS (SELECT seq, min(doc_id) AS least FROM windows GROUP BY seq),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places
  FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 13)) AS p FROM windows w JOIN firsts f ON w.seq = f.seq AND f.least < w.doc_id)
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]), ' '), '') END) AS kept_sha256
FROM words d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
