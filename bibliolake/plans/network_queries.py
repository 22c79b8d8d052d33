"""Keyword co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as n
from .registry import over_papers

GRAPH = """
terms AS (SELECT file_id, unnest(list_distinct(keywords)) AS k FROM papers),
nodes AS (SELECT k AS keyword, count(*) AS freq FROM terms GROUP BY k),
edges AS (SELECT a.k AS src, b.k AS dst, count(*) AS weight FROM terms a JOIN terms b
  ON a.file_id = b.file_id AND a.k < b.k GROUP BY ALL),
best AS (SELECT * FROM nodes ORDER BY freq DESC, keyword LIMIT 25),
star AS (SELECT CASE WHEN src = 'The' THEN dst ELSE src END AS neighbour, weight FROM edges
  WHERE src = 'The' OR dst = 'The' ORDER BY weight DESC, neighbour LIMIT 30)"""
SUBGRAPH = (
    "SELECT src, dst, weight FROM edges WHERE src IN (SELECT keyword FROM best) AND dst IN (SELECT keyword FROM best) "
    "AND weight >= 2"
)


@over_papers("agg_21_keyword_frequency", "SELECT keyword, freq FROM nodes", ctes=GRAPH)
def nodes(p):
    return n.keyword_nodes(p)


@over_papers("agg_22_keyword_pairs", "SELECT src, dst, weight FROM edges", ctes=GRAPH)
def edges(p):
    return n.keyword_edges(p)


over_papers("net_01_nodes", "SELECT keyword, freq FROM nodes", ctes=GRAPH)(nodes)
over_papers("net_01_edges", "SELECT src, dst, weight FROM edges", ctes=GRAPH)(edges)
over_papers("join_07_pairs_within_a_paper", "SELECT src, dst, weight FROM edges", ctes=GRAPH)(edges)


@over_papers("flt_14_minimum_edge_weight", "SELECT src, dst, weight FROM edges WHERE weight >= 5", ctes=GRAPH)
def heavy_edges(p):
    return n.keyword_edges(p, min_weight=5)


@over_papers("net_02_subgraph_edges", SUBGRAPH, ctes=GRAPH)
def subgraph_edges(p):
    return n.top_subgraph(p)[1]


over_papers("join_06_edges_between_top_nodes", SUBGRAPH, ctes=GRAPH)(subgraph_edges)


@over_papers("net_02_subgraph_nodes", "SELECT keyword, freq FROM best", ctes=GRAPH)
def subgraph_nodes(p):
    return n.top_subgraph(p)[0].select("keyword", "freq")


over_papers("top_10_nodes", "SELECT keyword, freq FROM best", ctes=GRAPH)(subgraph_nodes)


@over_papers("net_03_ego_edges", "SELECT 'The' AS src, neighbour AS dst, weight FROM star", ctes=GRAPH)
def ego_edges(p):
    return n.ego_network(p, " The ")[1]


@over_papers(
    "net_04_ego_nodes",
    "SELECT keyword, freq, round(12 + 5 * ln(1 + freq), 6) AS weight, keyword = 'The' AS is_query FROM nodes "
    "WHERE keyword = 'The' OR keyword IN (SELECT neighbour FROM star)",
    ctes=GRAPH,
)
def ego_nodes(p):
    drawn = n.ego_network(p, "The")[0]
    return drawn.withColumn("weight", F.round("weight", 6))


@over_papers("top_11_neighbours", "SELECT neighbour, weight FROM star", ctes=GRAPH)
def neighbours(p):
    return n.neighbours(p, "The")


@over_papers("top_12_ranked_keywords", "SELECT keyword, freq FROM nodes ORDER BY freq DESC, lower(keyword), keyword", ctes=GRAPH)
def ranked_nodes(p):
    return n.ranked_nodes(p)
