"""Keyword co-occurrence graph: nodes with frequency, undirected weighted edges.

Pairs are formed inside the row of a paper and counted with a partial aggregate;
there is no self-join. Keywords that cannot appear in the result are removed
before pairing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import distinct_terms
from ..functions.scalars import node_weight

TOP_NODES = 25
MIN_WEIGHT = 2
NEIGHBOURS = 30
WIDE_PAPER = 512
#: Words of 64 bits that tell which keywords may be frequent, 128 KB in all.
FILTER_WORDS = 1 << 14


def _terms(df: DataFrame) -> DataFrame:
    return df.select(distinct_terms(F.col("keywords")).alias("terms"))


def keyword_nodes(df: DataFrame) -> DataFrame:
    """Papers per keyword; a keyword counts once per paper."""
    long = _terms(df).select(F.explode_outer("terms").alias("keyword")).filter("keyword is not null")
    return long.groupBy("keyword").agg(F.count("*").alias("freq"))


def ranked_nodes(df: DataFrame) -> DataFrame:
    """All keywords by frequency, then by name without regard to case."""
    return keyword_nodes(df).orderBy(F.desc("freq"), F.lower("keyword"), "keyword")


def _top_nodes(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.orderBy(F.desc("freq"), "keyword").limit(n)


def _pairs(terms: DataFrame, longest: int | None = None) -> DataFrame:
    """One row per pair ``src < dst`` of a sorted list.

    Each term is paired with the rest of its list. The anchors of a very long
    list are spread over all tasks first, so one huge paper does not keep a
    single task busy; ``longest`` tells that no list is longer than this.
    """
    anchors = terms.select(F.posexplode_outer("terms").alias("at", "src"), "terms").select(
        "at", "src", F.slice("terms", F.col("at") + 2, F.size("terms")).alias("rest")
    )
    if longest is None or longest > WIDE_PAPER:
        # Position and rest give the length of the list. Asking the list itself
        # would let the optimizer build it once more for the filter.
        wide = F.col("at") + F.size("rest") >= WIDE_PAPER
        spread = anchors.filter(wide).repartition("src", "rest")
        anchors = anchors.filter(~wide).unionByName(spread)
    return anchors.select("src", F.explode_outer("rest").alias("dst")).filter("dst is not null")


def _weighted(pairs: DataFrame, min_weight: int) -> DataFrame:
    edges = pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return edges.filter(F.col("weight") >= min_weight) if min_weight > 1 else edges


def _slot(term: Column) -> tuple[Column, Column]:
    """Word and bit of a keyword in the filter."""
    place = F.pmod(F.xxhash64(term), F.lit(FILTER_WORDS * 64))
    return F.floor(place / 64).cast("int"), F.pmod(place, F.lit(64)).cast("int")


def frequent_filter(df: DataFrame, at_least: int) -> Column:
    """Bits of the keywords that enough papers hold, as one array for all rows. Other
    keywords may share a bit, so the filter only ever lets too many through."""
    word, bit = _slot(F.col("keyword"))
    frequent = keyword_nodes(df).filter(F.col("freq") >= at_least)
    words = frequent.groupBy(word.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits"))
    every = df.sparkSession.range(FILTER_WORDS).select(F.col("id").cast("int").alias("id")).join(words, "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(ordered, lambda x: x["bits"])).scalar()


def frequent_terms(df: DataFrame, at_least: int) -> DataFrame:
    """Lists of keywords without those that fewer papers hold, but for chance hits."""
    kept = frequent_filter(df, at_least)

    def held(term: Column) -> Column:
        word, bit = _slot(term)
        return F.call_function("shiftright", F.get(F.col("bits"), word), bit).bitwiseAND(F.lit(1)) == 1

    return _terms(df).withColumn("bits", kept).select(F.filter("terms", held).alias("terms"))


def keyword_edges(df: DataFrame, min_weight: int = 1) -> DataFrame:
    """Pairs of keywords with the number of papers holding both. A pair is never more
    frequent than its rarer keyword, so rare ones are left out before pairs are formed."""
    return _weighted(_pairs(_terms(df) if min_weight <= 1 else frequent_terms(df, min_weight)), min_weight)


def _as_array(df: DataFrame, column: str) -> Column:
    return df.agg(F.collect_list(column)).scalar()


def top_subgraph(
    df: DataFrame, n: int = TOP_NODES, min_weight: int = MIN_WEIGHT
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` among the n most frequent keywords. Nodes without an
    edge stay. Lists are cut to the n keywords before pairing, so a paper gives
    at most n·(n-1)/2 pairs."""
    nodes = _top_nodes(keyword_nodes(df), n)
    kept = F.array_intersect("terms", _as_array(nodes, "keyword"))
    edges = _weighted(_pairs(_terms(df).select(F.sort_array(kept).alias("terms")), longest=n), min_weight)
    return styled(nodes), edges


def styled(nodes: DataFrame, query: str | None = None) -> DataFrame:
    """Drawing attributes of the nodes."""
    marked = F.col("keyword") == query if query is not None else F.lit(False)
    return nodes.select(
        "keyword", "freq", node_weight(F.col("freq")).alias("weight"), marked.alias("is_query")
    )


def neighbours(df: DataFrame, keyword: str, n: int = NEIGHBOURS) -> DataFrame:
    """Keywords sharing most papers with the given one. Only papers holding it
    are looked at, and no pair but its own is formed."""
    holding = _terms(df).filter(F.array_contains("terms", keyword.strip()))
    others = holding.select(F.explode_outer("terms").alias("neighbour"))
    counted = (
        others.filter(F.col("neighbour") != keyword.strip())
        .groupBy("neighbour")
        .agg(F.count("*").alias("weight"))
    )
    return counted.orderBy(F.desc("weight"), "neighbour").limit(n)


def ego_network(df: DataFrame, keyword: str, n: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the star around one keyword; both empty when it is
    unknown or stands alone."""
    query = keyword.strip()
    star = neighbours(df, query, n)
    edges = star.select(F.lit(query).alias("src"), F.col("neighbour").alias("dst"), "weight")
    members = star.select(F.explode(F.array("neighbour", F.lit(query))).alias("keyword")).distinct()
    # At most n + 1 names, so the lists are cut to them before they are exploded.
    shown = F.array_intersect("terms", _as_array(members, "keyword"))
    long = _terms(df).select(F.explode_outer(shown).alias("keyword")).filter("keyword is not null")
    nodes = long.groupBy("keyword").agg(F.count("*").alias("freq"))
    return styled(nodes, query), edges

