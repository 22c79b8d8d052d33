"""Near copies by SimHash: fingerprints of three-word shingles, linked by searches
in BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

from .bktree import Forest, join_groups
from .common import id_text
from .components import components

#: Fixed values of the fingerprint.
SEED, SHINGLE, RADIUS = 42, 3, 3
#: Shingles that are hashed at a time.
BLOCK = 1 << 16
#: Parts that a fingerprint is cut into.
PARTS = 5
#: Fingerprints of one tree at most, and of one search.
TREE = 2048
#: Values, and pairs of a query and a node, that a task works on at a time.
WORK = 1 << 18


def fingerprint(text: str | None) -> int:
    """SimHash of the whole text as an unsigned number. A bit is set if it is set in
    over half of the hashes of the shingles, repeats included. Fewer words than a
    shingle has are one shingle; without a word it is 0."""
    # On bytes, lower() changes A-Z only and split() cuts at space and 9 to 13 only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - SHINGLE + 1, 1)
    starts, ends = starts[:last], ends[-last:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, last, BLOCK):
        spans = zip(starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > last, bitorder="little").tobytes(), "little")


def fingerprint_column(text: str = "text") -> Column:
    """The fingerprint as a signed bigint, which has the same 64 bits."""

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return prints(F.col(text))


def as_hex(value: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _part_keys(fp: Column) -> Column:
    """One number for each choice of two of the five parts. Three bits lie in three
    parts at most, so fingerprints within the radius agree in some choice."""
    edges = [64 * i // PARTS for i in range(PARTS + 1)]
    parts = [
        F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])
    ]
    return F.array(
        *[
            F.shiftleft(parts[i], 20) + parts[j] + F.lit(number << 40)
            for number, (i, j) in enumerate(combinations(range(PARTS), PARTS - RADIUS))
        ]
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each row's tree and queries, as few as join their groups."""

    def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(name)
        sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
        return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes

    for batch in batches:
        values, sizes = column(batch, "tree")
        queries, asked = column(batch, "queries")
        row = 0
        value_ends, query_ends = np.cumsum(sizes), np.cumsum(asked)
        while row < len(sizes):
            done = (value_ends[row - 1], query_ends[row - 1]) if row else (0, 0)
            until = max(row + 1, int(np.searchsorted(value_ends + query_ends, sum(done) + WORK, "right")))
            own = values[done[0] : value_ends[until - 1]]
            ask = queries[done[1] : query_ends[until - 1]]
            forest = Forest(own, np.repeat(np.arange(until - row), sizes[row:until]))
            of = np.repeat(np.arange(until - row), asked[row:until])
            names, place = np.unique(np.concatenate((own, ask)), return_inverse=True)
            group = np.arange(len(names))
            block = max(1, WORK * 8 // int(sizes[row:until].max()))
            for i in range(0, len(ask), block):
                query, node = forest.within(ask[i : i + block], of[i : i + block], RADIUS)
                group = join_groups(group, place[len(own) + i + query], place[node])
            tied = np.flatnonzero(group != np.arange(len(names)))
            if len(tied):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[tied].view(np.int64)), pa.array(names[group[tied]].view(np.int64))], ["a", "b"]
                )
            row = until


def links(fingerprints: DataFrame, tree_size: int = TREE) -> DataFrame:
    """Links ``(a, b)`` that connect the same fingerprints as all pairs at three or
    fewer differing bits do; ``fingerprints`` has distinct values ``fp``.

    Fingerprints that agree in two of five parts meet in a bucket. A bucket is cut
    into shards of about ``tree_size`` values, each a BK-tree, and for every two
    shards one searches the tree of the other. So no task holds more than two
    shards, however large a bucket is, and no pair is left out. The trees travel
    by the shuffle, not by a broadcast, because their number grows with the input.
    """
    keyed = fingerprints.select("fp", F.explode(_part_keys(F.col("fp"))).alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shards = F.ceil(F.col("n") / tree_size)
    dealt = keyed.join(full, "key").select(
        "key", "fp", F.pmod(F.xxhash64("fp"), shards).alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), shards - 1)).alias("other")
    )
    cells = dealt.groupBy("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(
        F.collect_list(F.when(F.col("own") == F.least("own", "other"), F.col("fp"))).alias("tree"),
        F.collect_list(F.when(F.col("own") == F.greatest("own", "other"), F.col("fp"))).alias("queries"),
    )
    both = cells.where((F.size("tree") > 0) & (F.size("queries") > 0)).select("tree", "queries")
    return both.mapInArrow(_search, "a bigint, b bigint")


def assign(prints: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(fp, component_id, component_fp)`` for every distinct fingerprint of
    ``prints (id, fp)``: the smallest id of its component and a fingerprint that a
    row with this id has. Nothing about single documents leaves the executors."""
    firsts = through_table(prints.groupBy("fp").agg(F.min(id_column).alias("first")), "fingerprints")
    nodes = components(links(firsts.select("fp")))
    # A missing id only stands for a component without any other.
    first = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "fp")
    linked = firsts.join(nodes, F.col("fp") == F.col("node")).select("fp", "root", first.alias("first"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    found = linked.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.fp").alias("component_fp"))
    return firsts.join(found, "fp", "left").select(
        "fp",
        F.when(F.col("component_fp").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component_fp", "fp").alias("component_fp"),
    )


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row. Null, empty and blank texts
    have the fingerprint zero and are linked like any other; repeated rows appear as
    often as they are given; an empty table gives none; other columns are not read."""
    prints = through_table(docs.select(F.col(id_column), fingerprint_column(text).alias("fp")), "prints")
    return prints.join(assign(prints, id_column), "fp").select(id_column, as_hex().alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, with all its columns, of each component: one with the smallest id.
    Rows with equal id and fingerprint count as one document."""
    marked = through_table(docs.withColumn("__fp", fingerprint_column(text)), "marked")
    chosen = assign(marked.select(id_column, F.col("__fp").alias("fp")), id_column).select(
        F.concat_ws("|", id_text("component_id"), "component_fp").alias("__key")
    )
    kept = marked.withColumn("__key", F.concat_ws("|", id_text(id_column), "__fp")).join(chosen.distinct(), "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
