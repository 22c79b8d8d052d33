import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bibliolake.operators import metrics as m
from bibliolake.operators import selection as s


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_group_of_nulls(make_papers):
    p = make_papers({"year": 2018, "refcount": "n/a", "subjects": ["Math"]}, {"year": None, "refcount": "3"})
    assert rows(m.by_year(p, "references")) == [(2018, None), (None, 3.0)]
    assert rows(m.subject_metric(p, "references")) == [("Math", 0.0)]


def test_null_years(make_papers):
    p = make_papers({"year": 2019}, {"year": None}, {"year": 2018})
    assert rows(m.by_year(p)) == [(2018, 1), (2019, 1), (None, 1)]
    assert rows(m.by_year(p, keep_null_group=False)) == [(2018, 1), (2019, 1)]
    assert rows(s.domain(p, "year")) == [(2018,), (2019,)]


def test_citation_range(make_papers):
    p = make_papers({"citedbycount": None}, {"citedbycount": 0}, {"citedbycount": 5}, {"citedbycount": 9})
    ids = lambda df: sorted(r.file_id for r in df.collect())
    assert ids(s.filter_papers(p, cited=(1, 5))) == [0, 2]
    assert ids(s.filter_papers(p, cited=(0, 5), null_as_zero=True)) == [0, 1, 2]
    assert ids(s.filter_papers(p, cited=(1, 5), null_as_zero=True)) == [2]


def test_search(make_papers):
    p = make_papers({"citation_title": "axb"}, {"citation_title": "a.b"}, {"keywords": ["xA.By"]}, {"abstracts": "none"})
    ids = lambda df: sorted(r.file_id for r in df.collect())
    assert ids(s.filter_papers(p, query="A.B")) == [0, 1, 2]
    assert ids(s.filter_papers(p, query="a.b", literal=True)) == [1, 2]
    assert ids(s.filter_papers(p, query="  ")) == [0, 1, 2, 3]
    with pytest.raises(PySparkException):
        s.filter_papers(p, query="(").collect()


def test_publishers(make_papers):
    p = make_papers({"publishername": None}, {"publishername": "B"}, {"publishername": "A"}, {"publishername": "B"})
    assert s.filter_papers(p, publishers=["—", "A"]).count() == 2
    assert s.filter_papers(p, publishers=[]).count() == 0
    assert rows(m.top_values(p, "publishers", 3)) == [("B", 2), ("A", 1), ("—", 1)]
    assert sorted(r.file_id for r in s.of_top_publishers(p, 2).collect()) == [1, 2, 3]


def test_ties_by_key(make_papers):
    p = make_papers({"keywords": ["b", "a", "", "c", "c"]})
    assert rows(m.top_values(p, "keywords", 2)) == [("c", 2), ("a", 1)]


def test_normalized_references(make_papers):
    p = make_papers(
        {"year": 2018, "refcount": "6", "authors_count": 2, "funding_count": 1},
        {"year": 2018, "refcount": "6", "authors_count": 0, "funding_count": 0},
    )
    assert rows(m.by_year(p, "normalized_references", "mean")) == [(2018, 2.0)]
    assert sorted(r.ref_ratio for r in m.reference_ratio(p).collect()) == [3.0, 6.0]


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 10], [5], [0, 0, 0, 1_000_000_000], [-3, 7, 7, 8, 100_000]])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.8, 1.0])
def test_exact_quantile(spark, values, q):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint")
    assert m.exact_quantile(df, "v", q).first()[0] == pytest.approx(np.quantile(values, q))


def test_exact_quantile_random(spark):
    values = np.random.default_rng(1).zipf(1.3, 3000).clip(max=10**9).astype(int).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert m.exact_quantile(df, "v", 0.8).first()[0] == pytest.approx(np.quantile(values, 0.8))
    assert m.exact_quantile(df.limit(0), "v", 0.8).first()[0] is None


def test_top_cited_by_subject(make_papers):
    twice = [("Math", "MATH"), ("Math", "MA"), ("Art", "ARTS")]
    p = make_papers(
        {"citedbycount": 3, "categories": twice}, {"citedbycount": None, "subjects": ["Math"]},
        {"citedbycount": 9, "subjects": ["Math"]}, {"citedbycount": 3, "subjects": ["Math"]},
    )
    one = [(r.file_id, r.cited_by) for r in m.top_cited_by_subject(p, "Math", 3).collect()]
    assert one == [(2, 9), (0, 3), (3, 3)]
    every = m.top_cited_by_subject(p, n=3).orderBy("subject", "rank").collect()
    assert [(r.subject, r.file_id) for r in every] == [("Art", 0), ("Math", 2), ("Math", 0), ("Math", 3)]


def test_rank_limit_before_the_shuffle(make_papers):
    plan = m.top_cited_by_subject(make_papers({"subjects": ["Math"]}))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_counts_add_up(papers):
    total = papers.count()
    assert sum(r.value for r in m.by_year(papers).collect()) == total
    assert m.kpis(papers).first().papers == total
    ratio = m.ratio_histogram(papers, 0.5).agg(F.sum("papers")).first()[0]
    assert ratio == total


def test_share_sums_to_hundred(papers):
    shares = m.top_values(papers, "subjects", 10, share=True).collect()
    assert sum(r.percent for r in shares) == pytest.approx(100)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.8, 0.999, 1.0])
def test_exact_quantile_with_outliers(spark, q):
    rng = random.Random(3)
    values = [rng.randint(0, 10**6) for _ in range(3000)] + [10**15, -(10**17), 2**63 - 1, -(2**63), 7, 7, 7]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    ordered, at = sorted(values), (len(values) - 1) * q
    low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
    assert m.exact_quantile(frame, "v", q).first()[0] == pytest.approx(low + (high - low) * (at - int(at)))


def test_exact_quantile_of_nothing(spark):
    assert m.exact_quantile(spark.createDataFrame([(None,)], "v bigint"), "v", 0.5).first()[0] is None


def test_share_of_all_groups(make_papers):
    p = make_papers(*[{"sourcetitle": t} for t in "aab"])
    assert [(r.journal, round(r.percent, 3)) for r in m.top_values(p, "journals", None, share=True).collect()] == [("a", 66.667), ("b", 33.333)]
