"""Near copies at a similarity: SimHash of five-word shingles, BK-trees of the
documents that can be alike, and an exact check of the links that can join groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

from .bktree import Forest, join_groups
from .components import components

#: Words of a shingle and least share of common ones.
SHINGLE, SIMILARITY = 5, 0.8
#: Differing bits of a candidate. At a similarity of 0.8 the bits differ with a chance
#: of 0.15, 9.7 of 64 on average, and 0.1 % of the pairs have more than 18.
RADIUS = 18
#: Bands of a text and least shingles in each. At 0.8 some band agrees in 99.8 %.
BANDS, ROWS = 12, 4
#: Seeds of the shingles, of the words as a whole and of the bands.
SEED, WHOLE_SEED = 42, 7
#: Documents of one tree at most.
TREE = 2048
#: Shingles that are worked on at a time, in a text and in the texts compared with one.
BLOCK, CHECKED = 1 << 14, 1 << 22
#: Bytes of texts in one shard of a band at most.
BYTES = 16 << 20
#: Closest texts that one text is compared with at first, and by how many times more then.
FIRST, MORE = 32, 8

_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _words(text: str | None) -> list[bytes]:
    # On bytes, lower() changes A-Z only and split() cuts at space and 9 to 13 only.
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the whole text. Fewer words than a
    shingle has are one shingle; without a word there is none."""
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - size + 1, 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[-last:].tolist())
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, last))


def sketch(text: str | None) -> tuple[int, int, list[int]]:
    """Hash of the words in order, SimHash of the distinct shingles and one key for
    each band; a text without a word has no bands."""
    hashes = shingles(text)
    node = xxhash.xxh64_intdigest(b" ".join(_words(text)), WHOLE_SEED)
    if not len(hashes):
        return node, 0, []
    counts = np.zeros(64, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        # The upper half decides, as the lower bits of a product mix too little.
        mixed = (part ^ (part >> np.uint64(31)))[:, None] * _FACTOR + _SHIFT
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    packed = np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()
    keys = [xxhash.xxh64_intdigest(band.tobytes(), number) for number, band in enumerate(least.reshape(BANDS, ROWS))]
    return node, int.from_bytes(packed, "little"), keys


def sketch_column(text: str = "text") -> Column:
    """``struct<node, fp, keys>`` of the whole text, numbers as signed bigints."""

    @F.pandas_udf("node bigint, fp bigint, keys array<bigint>")
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = [sketch(t) for t in texts]
        node, fp = (np.array([r[i] for r in rows], np.uint64).view(np.int64) for i in (0, 1))
        return pd.DataFrame({"node": node, "fp": fp, "keys": [np.array(r[2], np.uint64).view(np.int64) for r in rows]})

    return made(F.col(text))


def closest_links(a: np.ndarray, b: np.ndarray, distance: np.ndarray, members: int) -> np.ndarray:
    """Numbers of the links, the closest first, that join the same groups as all of them
    do: each group takes its closest link to another one until none is left."""
    group = np.arange(members)
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, distance))] = np.arange(len(a))
    left, chosen = np.arange(len(a)), []
    while True:
        left = left[group[a[left]] != group[b[left]]]
        if not len(left):
            return np.concatenate(chosen) if chosen else left
        best = np.full(members, len(a), np.int64)
        np.minimum.at(best, group[a[left]], rank[left])
        np.minimum.at(best, group[b[left]], rank[left])
        taken = left[(rank[left] == best[group[a[left]]]) | (rank[left] == best[group[b[left]]])]
        chosen.append(taken)
        group = join_groups(group, a[taken], b[taken])


def _cell_links(tree: np.ndarray, tree_nodes: np.ndarray, ask: np.ndarray, ask_nodes: np.ndarray, radius: int):
    """Links of nodes within one tree and its queries. Nodes of one fingerprint are tied
    to the first of them, which stands for all in the search."""
    nodes, place = np.unique(np.concatenate((tree_nodes, ask_nodes)), return_inverse=True)
    tree_at, ask_at = place[: len(tree)], place[len(tree) :]
    values, first, own = np.unique(tree, return_index=True, return_inverse=True)
    asked, ask_first, ask_own = np.unique(ask, return_index=True, return_inverse=True)
    query, node = Forest(values, np.zeros(len(values), np.int64)).within(asked, np.zeros(len(asked), np.int64), radius)
    a = np.concatenate((tree_at, ask_at, ask_at[ask_first[query]]))
    b = np.concatenate((tree_at[first[own]], ask_at[ask_first[ask_own]], tree_at[first[node]]))
    same = np.zeros(len(tree) + len(ask), np.int64)
    distance = np.concatenate((same, np.bitwise_count(asked[query] ^ values[node]).astype(np.int64)))
    taken = closest_links(a, b, distance, len(nodes))
    return nodes[a[taken]], nodes[b[taken]]


def candidates(sketches: DataFrame, radius: int = RADIUS, tree_size: int = TREE) -> DataFrame:
    """Links ``(a, b)``, ``a < b``, between nodes of ``sketches (node, fp, keys)``, whose
    nodes are distinct: within every band the closest ones that join the same groups as
    all fingerprints within the radius do.

    Bands with the same members are searched once. A band is cut into shards of about
    ``tree_size`` nodes, each a BK-tree, and for every two shards one searches the tree
    of the other, so a task holds two shards, however many documents a band has.
    """
    keyed = sketches.select("node", "fp", F.explode("keys").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).where("n > 1")
    once = full.groupBy("n", "members").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / tree_size).alias("shards"))
    dealt = _dealt(keyed.join(once, "key")).withColumn("one", F.struct("fp", "node"))
    cells = dealt.groupBy("key", "low", "high").agg(
        F.collect_list(F.when(F.col("own") == F.col("low"), F.col("one"))).alias("tree"),
        F.collect_list(F.when(F.col("own") == F.col("high"), F.col("one"))).alias("queries"),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("tree", "queries"):
                lists = batch.column(name)
                ends = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy(zero_copy_only=False)))))
                flat = lists.flatten()
                sides.append((ends, flat.field("fp").to_numpy().view(np.uint64), flat.field("node").to_numpy()))
            found = []
            (te, tf, tn), (qe, qf, qn) = sides
            for row in range(batch.num_rows):
                t, q = slice(te[row], te[row + 1]), slice(qe[row], qe[row + 1])
                found.append(_cell_links(tf[t], tn[t], qf[q], qn[q], radius))
            if found:
                a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    some = cells.where((F.size("tree") > 0) & (F.size("queries") > 0)).select("tree", "queries")
    return some.mapInArrow(search, "a bigint, b bigint").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``node`` and ``shards`` in each cell, two shards ``low`` and ``high`` of
    their band, of which ``own`` is theirs."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("shards"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1))
    )
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "shards")


def _joining(
    fp: np.ndarray, root: np.ndarray, keys: np.ndarray, band: int, texts: list[str], sides: tuple[np.ndarray, np.ndarray],
    radius: int, similarity: float,
) -> list[tuple[int, int]]:
    """Pairs of rows, one of either side, that are alike and join all that is joined by the
    alike pairs within the radius whose first common band is this one. Both sides are
    numbers of rows; where they are the same rows, each pair is looked at once."""
    tree, ask = sides
    group = np.unique(root, return_inverse=True)[1]
    values, own = np.unique(fp[tree], return_inverse=True)
    asked, ask_own = np.unique(fp[ask], return_inverse=True)
    query, value = Forest(values, np.zeros(len(values), np.int64)).within(asked, np.zeros(len(asked), np.int64), radius)
    order = np.argsort(query, kind="stable")
    value, start = value[order], np.searchsorted(query[order], np.arange(len(asked) + 1))
    numbers, size, mark = None, None, None
    found = []
    for q, at in zip(ask.tolist(), ask_own.tolist()):
        near = np.zeros(len(values), bool)
        near[value[start[at] : start[at + 1]]] = True
        left = tree[near[own]]
        if tree is ask:
            left = left[left > q]
        left = left[group[left] != group[q]]
        left = left[(keys[left] == keys[q]).argmax(axis=1) == band]
        if not len(left):
            continue
        if numbers is None:  # many cells have no pair left
            hashes = [shingles(t) for t in texts]
            size = np.array([len(h) for h in hashes])
            distinct, flat = np.unique(np.concatenate(hashes), return_inverse=True)
            numbers, mark = np.split(flat.astype(np.int32), np.cumsum(size)[:-1]), np.zeros(len(distinct), bool)
        enough = lambda common, rows: common >= similarity * (size[q] + size[rows] - common)  # noqa: B023,E731
        left = left[enough(np.minimum(size[q], size[left]), left)]
        left = left[np.argsort(np.bitwise_count(fp[left] ^ fp[q]), kind="stable")]
        mark[numbers[q]] = True
        most = FIRST
        while len(left):
            now = left[: max(1, min(most, int(np.searchsorted(np.cumsum(size[left]), CHECKED, "right"))))]
            starts = np.cumsum(size[now]) - size[now]
            common = np.add.reduceat(mark[np.concatenate([numbers[i] for i in now])], starts, dtype=np.int64)
            left = left[len(now) :]
            for i in now[enough(common, now)].tolist():
                if group[i] != group[q]:
                    found.append((q, i))
                    group[group == group[i]] = group[q]
            left = left[group[left] != group[q]]
            most *= MORE
        mark[numbers[q]] = False
    return found


def joining(
    sketches: DataFrame, roots: DataFrame, failed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY,
    radius: int = RADIUS, tree_size: int = TREE,
) -> DataFrame:
    """Links ``(a, b)`` between roots of nodes: all that join groups by pairs of a band, within
    the radius, that are alike on the whole texts ``(node, text)``.

    Groups with such a pair between them are both in a band with one of the ``failed (a, b)``
    links of ``candidates``, whose ends have different roots. The pairs are checked where
    the texts of two shards meet, each in the first of its bands, and leave a task only
    when they join two groups, so two shards send fewer links than they have nodes.
    """
    kept = [sketches.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}")) for c in ("a", "b")]
    shared = F.explode(F.array_intersect("keys_a", "keys_b"))
    bands = failed.join(kept[0], "a").join(kept[1], "b").select(shared.alias("key")).distinct()
    sizes = texts.select("node", F.octet_length("text").cast("bigint").alias("bytes"))
    rooted = sketches.join(sizes, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = rooted.select("node", "fp", "root", "keys", "bytes", F.posexplode("keys").alias("band", "key")).join(bands, "key", "left_semi")
    full = keyed.groupBy("key", "band").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("members")
    )
    # Of bands with the same members the first, in which each pair of theirs is looked at.
    once = full.groupBy("n", "members").agg(F.min(F.struct("band", "key", "bytes")).alias("one"))
    shards = once.select("one.key", F.ceil(F.greatest(F.col("n") / tree_size, F.col("one.bytes") / BYTES)).alias("shards"))
    dealt = _dealt(keyed.drop("bytes").join(shards, "key")).join(texts, "node")

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        column = lambda c: table[c].to_numpy()
        root, own, low, high = map(column, ("root", "own", "low", "high"))
        rows = np.arange(len(own))
        sides = (rows, rows) if low[0] == high[0] else (np.flatnonzero(own == low), np.flatnonzero(own == high))
        found = []
        if all(map(len, sides)):
            keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
            texts = table["text"].to_pylist()
            found = _joining(column("fp").view(np.uint64), root, keys, table["band"][0].as_py(), texts, sides, radius, similarity)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(root[a], root[b]), "b": np.maximum(root[a], root[b])})

    return dealt.groupBy("key", "low", "high").applyInArrow(search, "a bigint, b bigint")


def alike(a: str = "text_a", b: str = "text_b", similarity: float = SIMILARITY) -> Column:
    """Whether the distinct shingles of two texts have this share in common."""

    @F.pandas_udf("boolean")
    def checked(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for s, t in zip(left, right):
            x, y = shingles(s), shingles(t)
            common = len(np.intersect1d(x, y, assume_unique=True))
            found.append(common >= similarity * (len(x) + len(y) - common))
        return pd.Series(found, dtype=bool)

    return checked(F.col(a), F.col(b))


def _marked(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    # Maps and variants cannot be hashed; they decide nothing.
    told = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.xxhash64(*told).alias("row"))
    return docs.withColumns({"__sketch": sketch_column(text), "__order": order})


def _groups(marked: DataFrame, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(node, first, fp, keys)`` of every node and ``(node, root)`` of the linked ones."""
    nodes = through_table(
        marked.groupBy(F.col("__sketch.node").alias("node")).agg(
            F.min("__order").alias("first"), F.first("__sketch.fp").alias("fp"), F.first("__sketch.keys").alias("keys")
        ),
        "nodes",
    )
    sketches = nodes.select("node", "fp", "keys")
    links = through_table(candidates(sketches), "candidates")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Every node sends the text of its first row, once. A node with any candidate has one here.
    firsts = ends.join(nodes.select("node", "first"), "node").select("node", F.col("first").alias("__order"))
    sent = marked.select(F.col("__sketch.node").alias("node"), "__order", F.col(text).alias("text"))
    texts = through_table(sent.join(firsts, ["node", "__order"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    pairs = links.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    checked = through_table(pairs.select("a", "b", alike(similarity=similarity).alias("alike")), "checked")
    roots = through_table(components(checked.where("alike").select("a", "b")), "roots")
    # Groups that have unchecked links between them have a failed one too.
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    failed = checked.where("not alike").join(ends[0], "a", "left").join(ends[1], "b", "left")
    apart = failed.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    more = through_table(joining(sketches, roots, through_table(apart, "failed"), texts, similarity), "joining")
    if more.isEmpty():
        return nodes, roots
    merged = through_table(components(more), "merged")
    moved = merged.select(F.col("node").alias("root"), F.col("root").alias("now"))
    own = roots.join(moved, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return nodes, own.unionByName(merged.join(roots, "node", "left_anti"))


def _least(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, least)``: the first row of the group of every node."""
    linked = nodes.join(roots, "node").select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    found = linked.join(least, "root").select("node", "least")
    return nodes.select("node", "first").join(found, "node", "left").select("node", F.coalesce("least", "first").alias("least"))


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id, group_id)`` of every row: the smallest id of the documents that links of at
    least this similarity of five-word shingles reach, A-Z lower-cased.

    Texts of equal words are one node. Null, empty and blank texts are one group; texts
    of fewer than five words are alike only when their words are equal; repeated rows
    appear as often as they are given; a null id comes after all others; an empty table
    gives none; other columns only tell rows of one id apart. Every link is checked
    exactly. The closest links of a band are checked first; where one of them fails, all
    that are left between two groups of the band follow.
    """
    marked = through_table(_marked(docs, id_column, text).select(F.col(id_column).alias("id"), F.col(text).alias("text"), "__sketch", "__order"), "marked")
    nodes, roots = _groups(marked, "text", similarity)
    rows = marked.select("id", F.col("__sketch.node").alias("node")).join(_least(nodes, roots), "node")
    return rows.select(F.col("id").alias(id_column), F.col("least.id").alias("group_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row, with all its columns, of each group of ``groups``: the one with the
    smallest id, and of several rows with this id the same one in every run."""
    marked = through_table(_marked(docs, id_column, text), "marked")
    nodes, roots = _groups(marked, text, similarity)
    # All nodes of a group name the same row, which has one of these nodes.
    chosen = _least(nodes, roots).select(F.col("least").alias("__order")).distinct()
    kept = marked.join(chosen, "__order", "left_semi")
    return kept.dropDuplicates(["__order"]).select(*[F.col(f"`{c}`") for c in docs.columns])
