from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from bibliolake.operators import network as n
from bibliolake.operators import trends as t


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def dated(make_papers):
    return make_papers(
        {"year": 2010, "publication_date": "01/01/2010", "keywords": ["old"]},
        {"year": 2015, "publication_date": "03/05/2015", "keywords": ["a", "b"]},
        {"year": 2016, "publication_date": None, "keywords": ["a"]},
        {"year": 2018, "publication_date": "09/02/2018", "keywords": ["a", "c", "a"]},
        {"year": None, "publication_date": "09/02/2018", "keywords": ["z", "z", "z", "z", "z"]},
    )


def test_literature_trend(dated):
    assert rows(t.literature_trend(dated, cumulative=True)) == [(2010, 1, 1), (2015, 1, 2), (2016, 1, 3), (2018, 1, 4)]
    assert rows(t.literature_trend(dated, "month")) == [("2010-01", 1), ("2015-05", 1), ("2018-02", 2)]


def test_keyword_trend(dated):
    assert rows(t.keyword_trend(dated, n=2, last_years=3)) == [(2015, "a", 1), (2016, "a", 1), (2018, "a", 2), (2015, "b", 1)]
    running = rows(t.keyword_trend(dated, "cumulative", n=1, last_years=3))
    assert running == [(2015, "a", 1), (2016, "a", 2), (2018, "a", 4)]
    months = [(str(p), k, v) for p, k, v in rows(t.keyword_trend(dated, "month", n=1, last_years=3))]
    assert months == [("2015-05-01", "a", 1), ("2018-02-01", "a", 2)]


def test_grid_fills_with_zero_or_carries_forward(dated):
    grid = sorted(rows(t.keyword_grid(dated, "cumulative", n=2, last_years=3)))
    assert grid == [(2015, "a", 1), (2015, "b", 1), (2016, "a", 2), (2016, "b", 0), (2018, "a", 4), (2018, "b", 0)]
    carried = sorted(rows(t.keyword_grid(dated, "cumulative", n=2, last_years=3, carry_forward=True)))
    assert [v for _, k, v in carried if k == "b"] == [1, 1, 1]
    months = rows(t.keyword_grid(dated, "month", n=3, last_years=3))
    assert len(months) == 2 * 3


def test_frames_as_intervals(dated):
    grid = t.keyword_grid(dated, "year", n=2)
    intervals = t.frame_intervals(grid)
    assert intervals.count() == grid.count()
    every = t.frames(grid).collect()
    for number in range(5):
        wanted = sorted(tuple(r) for r in every if r.frame == number)
        assert sorted(map(tuple, t.frame(intervals, number).collect())) == wanted
    assert t.frame_intervals(grid.limit(0)).count() == t.frames(grid.limit(0)).count() == 0


def test_frames(dated):
    grid = t.keyword_grid(dated, "year", n=2, last_years=3)
    frames = Counter(r.frame for r in t.frames(grid).collect())
    assert frames == {0: 2, 1: 4, 2: 6}
    assert t.axis_bound(grid).first()[0] == pytest.approx(2.1)
    plan = t.frames(grid)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def brute(papers):
    freq, pairs = Counter(), Counter()
    for r in papers.select("keywords").collect():
        terms = sorted({k.strip() for k in r.keywords if k.strip()})
        freq.update(terms)
        pairs.update(combinations(terms, 2))
    return freq, pairs


@pytest.mark.parametrize("wide", [512, 5])
def test_network_against_brute_force(papers, monkeypatch, wide):
    monkeypatch.setattr(n, "WIDE_PAPER", wide)
    freq, pairs = brute(papers)
    assert {r.keyword: r.freq for r in n.keyword_nodes(papers).collect()} == freq
    edges = {(r.src, r.dst): r.weight for r in n.keyword_edges(papers).collect()}
    assert edges == pairs
    assert all(w <= min(freq[a], freq[b]) for (a, b), w in edges.items())

    top = sorted(freq, key=lambda k: (-freq[k], k))[:25]
    nodes, links = n.top_subgraph(papers)
    assert {r.keyword for r in nodes.collect()} == set(top)
    expected = {p: w for p, w in pairs.items() if w >= 2 and set(p) <= set(top)}
    assert {(r.src, r.dst): r.weight for r in links.collect()} == expected


def test_one_huge_paper(make_papers):
    p = make_papers({"keywords": [f"k{i:04d}" for i in range(700)]}, {"keywords": ["k0000", "k0001"]})
    edges = n.keyword_edges(p)
    assert edges.count() == 700 * 699 // 2
    assert rows(edges.filter(F.col("weight") > 1)) == [("k0000", "k0001", 2)]


def test_ego_network(papers):
    freq, pairs = brute(papers)
    name = max(freq, key=lambda k: (freq[k], k))
    star = Counter({(set(p) - {name}).pop(): w for p, w in pairs.items() if name in p})
    best = sorted(star, key=lambda k: (-star[k], k))[:30]
    nodes, edges = n.ego_network(papers, f" {name}\n")
    assert {r.dst: r.weight for r in edges.collect()} == {k: star[k] for k in best}
    drawn = {r.keyword: (r.freq, r.is_query) for r in nodes.collect()}
    assert drawn == {k: (freq[k], k == name) for k in [*best, name]}


def test_unknown_or_lonely_keyword(make_papers):
    p = make_papers({"keywords": ["lonely"]}, {"keywords": ["a", "b"]})
    for keyword in ("unknown", "lonely"):
        nodes, edges = n.ego_network(p, keyword)
        assert edges.count() == 0 and nodes.count() == 0


def test_spellings_are_one_node(make_papers):
    p = make_papers({"keywords": ["deep\t", " deep"]}, {"keywords": ["deep"]})
    assert rows(n.keyword_nodes(p)) == [("deep", 2)]


def test_ranked_nodes(make_papers):
    p = make_papers({"keywords": ["b", "C", "a"]}, {"keywords": ["C"]})
    assert [r.keyword for r in n.ranked_nodes(p).collect()] == ["C", "a", "b"]


def rows_into(frame, node):
    """Largest number of rows that a node of the executed plan put out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found = []

    def walk(p):
        if hasattr(p, "finalPhysicalPlan") and "AdaptiveSparkPlan" in p.nodeName():
            p = p.finalPhysicalPlan()
        if "QueryStage" in p.nodeName():
            p = p.plan()
        if p.nodeName() == node:
            metric = p.metrics().get("numOutputRows")
            if metric.isDefined():
                found.append(metric.get().value())
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return max(found)


def test_rare_keywords_form_no_pairs(make_papers):
    # Keyword k<i> is alone in its paper, the others are in every fourth one.
    p = make_papers(*[{"keywords": [f"common{i % 4}", "all", *[f"k{i}_{j}" for j in range(20)]]} for i in range(40)])
    every = n.keyword_edges(p, 1)
    want = {(r.src, r.dst, r.weight) for r in every.collect() if r.weight >= 2}
    pruned = n.keyword_edges(p, 2)
    assert {(r.src, r.dst, r.weight) for r in pruned.collect()} == want and len(want) == 4
    assert 20 * rows_into(n.keyword_edges(p, 2), "Generate") < rows_into(n.keyword_edges(p, 1), "Generate")


def test_filter_of_few_bits_keeps_every_frequent_keyword(make_papers, monkeypatch):
    p = make_papers(*[{"keywords": [f"w{i % 7}", f"w{i % 5}", f"r{i}"]} for i in range(60)])
    want = {(r.src, r.dst, r.weight) for r in n.keyword_edges(p, 1).collect() if r.weight >= 2}
    monkeypatch.setattr(n, "FILTER_WORDS", 1)
    assert {(r.src, r.dst, r.weight) for r in n.keyword_edges(p, 2).collect()} == want
