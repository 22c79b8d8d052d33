"""Aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators.selection import funded, of_subject
from .registry import over_papers

SUBJECTS = "subject_rows AS (SELECT *, unnest(subjects) AS subject FROM counted)"
KEYWORDS = "keyword_rows AS (SELECT *, unnest(keywords) AS keyword FROM counted)"
FUNDERS = "funder_rows AS (SELECT *, unnest(funding) AS funder FROM counted WHERE funding_count > 0)"


def six(name):
    return F.round(name, 6).alias(name)


@over_papers(
    "agg_01_kpis",
    "SELECT count(*) AS papers, count(DISTINCT year) AS years_covered, CAST(sum(authors_count) AS BIGINT) AS authors_sum, "
    "CAST(sum(citedbycount) AS BIGINT) AS cited_by_sum FROM counted",
)
def kpis(p):
    return m.kpis(p)


@over_papers(
    "agg_02_kpis_with_span",
    "SELECT count(*) AS papers, min(year) AS first_year, max(year) AS last_year, "
    "CAST(sum(citedbycount) AS BIGINT) AS total_citations, CAST(sum(authors_count) AS BIGINT) AS total_authors FROM counted",
)
def kpis_with_span(p):
    return m.kpis_with_span(p)


@over_papers("agg_03_papers_per_year", "SELECT year, count(*) AS papers FROM papers GROUP BY year")
def papers_per_year(p):
    return m.by_year(p, "papers", name="papers")


@over_papers(
    "agg_04_papers_per_known_year",
    "SELECT year, count(*) AS papers FROM papers WHERE year IS NOT NULL GROUP BY year",
)
def papers_per_known_year(p):
    return m.by_year(p, "papers", keep_null_group=False, name="papers")


@over_papers("agg_05_authors_per_year", "SELECT year, CAST(sum(authors_count) AS BIGINT) AS authors FROM counted GROUP BY year")
def authors_per_year(p):
    return m.by_year(p, "authors", name="authors")


@over_papers("agg_06_citations_per_year", "SELECT year, CAST(sum(citedbycount) AS BIGINT) AS cited_by FROM counted GROUP BY year")
def citations_per_year(p):
    return m.by_year(p, "cited_by", name="cited_by")


@over_papers("agg_07_references_per_year", "SELECT year, sum(refs) AS refs FROM counted GROUP BY year")
def references_per_year(p):
    return m.by_year(p, "references", name="refs")


@over_papers("agg_08_mean_authors", "SELECT year, round(avg(authors_count), 6) AS avg_authors FROM counted GROUP BY year")
def mean_authors(p):
    return m.by_year(p, "authors", "mean", name="avg_authors").select("year", six("avg_authors"))


@over_papers(
    "agg_08_mean_authors_known_year",
    "SELECT year, round(avg(authors_count), 6) AS avg_authors FROM counted WHERE year IS NOT NULL GROUP BY year",
)
def mean_authors_known_year(p):
    means = m.by_year(p, "authors", "mean", keep_null_group=False, name="avg_authors")
    return means.select("year", six("avg_authors"))


@over_papers(
    "agg_09_mean_citations",
    "SELECT year, round(avg(coalesce(citedbycount, 0)), 6) AS avg_cited_by FROM counted WHERE year IS NOT NULL GROUP BY year",
)
def mean_citations(p):
    means = m.by_year(p, "cited_by_or_zero", "mean", keep_null_group=False, name="avg_cited_by")
    return means.select("year", six("avg_cited_by"))


@over_papers(
    "agg_10_normalized_references",
    "SELECT year, round(avg(refs / nullif(authors_count + funding_count, 0)), 6) AS avg_normalized_refs "
    "FROM counted WHERE year IS NOT NULL GROUP BY year",
)
def normalized_references(p):
    means = m.by_year(p, "normalized_references", "mean", keep_null_group=False, name="avg_normalized_refs")
    return means.select("year", six("avg_normalized_refs"))


@over_papers(
    "agg_11_papers_per_month",
    "SELECT strftime(pub_day, '%Y-%m') AS month, count(*) AS papers FROM counted WHERE pub_day IS NOT NULL GROUP BY 1",
)
def papers_per_month(p):
    return m.by_month(p)


@over_papers(
    "agg_12_subjects_per_year",
    "SELECT year, subject, count(*) AS papers FROM subject_rows WHERE year IS NOT NULL GROUP BY ALL",
    ctes=SUBJECTS,
)
def subjects_per_year(p):
    return m.subject_year(p)


@over_papers(
    "agg_13_keywords_per_subject",
    "SELECT subject, CAST(sum(len(keywords)) AS BIGINT) AS value FROM subject_rows GROUP BY subject",
    ctes=SUBJECTS,
)
def keywords_per_subject(p):
    return m.subject_metric(p, "keywords", None)


@over_papers("agg_14_papers_per_subject", "SELECT subject, count(*) AS value FROM subject_rows GROUP BY subject", ctes=SUBJECTS)
def papers_per_subject(p):
    return m.subject_metric(p, "papers", None)


@over_papers(
    "agg_15_references_per_subject",
    "SELECT subject, coalesce(sum(refs), 0.0::DOUBLE) AS value FROM subject_rows GROUP BY subject",
    ctes=SUBJECTS,
)
def references_per_subject(p):
    return m.subject_metric(p, "references", None)


@over_papers(
    "agg_16_subject_stats",
    "SELECT subject, count(*) AS papers_count, round(avg(coalesce(citedbycount, 0)), 6) AS avg_cited_by "
    "FROM subject_rows GROUP BY subject",
    ctes=SUBJECTS,
)
def subject_stats(p):
    return m.subject_stats(p).select("subject", "papers_count", six("avg_cited_by"))


@over_papers("agg_17_papers_per_funder", "SELECT funder, count(*) AS n FROM funder_rows GROUP BY funder", ctes=FUNDERS)
def papers_per_funder(p):
    return m.top_values(p, "funding", None)


FUNDED_SUBJECTS = (
    "SELECT subject, count(*) AS n FROM subject_rows WHERE len([f for f in funding if contains(lower(f), 'thon')]) > 0 "
    "GROUP BY subject"
)


@over_papers("agg_18_subjects_of_one_funder", FUNDED_SUBJECTS, ctes=SUBJECTS)
def subjects_of_one_funder(p):
    return m.subjects_funded_by(p, "thon", None)


@over_papers(
    "agg_23_papers_per_journal", "SELECT sourcetitle AS journal, count(*) AS n FROM papers GROUP BY 1"
)
def papers_per_journal(p):
    return m.top_values(p, "journals", None)


@over_papers(
    "agg_24_largest_journal",
    "SELECT max(n) AS largest FROM (SELECT count(*) AS n FROM papers GROUP BY sourcetitle)",
)
def largest_journal(p):
    return m.largest_group(p, "sourcetitle")


@over_papers("agg_25_distinct_journals", "SELECT count(DISTINCT sourcetitle) AS n_distinct FROM papers")
def distinct_journals(p):
    return m.n_distinct(p, "sourcetitle")


@over_papers("agg_26_citation_bounds", "SELECT min(citedbycount) AS low, max(citedbycount) AS high FROM papers")
def citation_bounds(p):
    return m.citation_bounds(p)


@over_papers("agg_27_citation_quantile", "SELECT round(quantile_cont(citedbycount, 0.8), 6) AS quantile FROM papers")
def citation_quantile(p):
    return m.exact_quantile(p, "citedbycount", 0.8).select(six("quantile"))


@over_papers(
    "agg_28_value_distribution",
    "SELECT authors_count, count(*) AS n FROM counted GROUP BY authors_count",
)
def value_distribution(p):
    return m.value_distribution(p, "authors_count")


@over_papers(
    "agg_29_ratio_histogram",
    "SELECT CAST(floor(r / 0.5) * 0.5 AS DOUBLE) AS bin_start, count(*) AS papers FROM (SELECT coalesce(refs, 0) / "
    "CASE WHEN authors_count = 0 THEN 1 ELSE authors_count END AS r FROM counted) GROUP BY 1",
)
def ratio_histogram(p):
    return m.ratio_histogram(p, 0.5)


SUBJECT_COUNTS = "SELECT subject, count(*) AS n FROM subject_rows GROUP BY subject ORDER BY n DESC, subject"


@over_papers(
    "agg_30_share_of_top_subjects",
    f"SELECT subject, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM ({SUBJECT_COUNTS} LIMIT 10)",
    ctes=SUBJECTS,
)
def share_of_top_subjects(p):
    return m.top_values(p, "subjects", 10, share=True).select("subject", "n", six("percent"))


@over_papers(
    "top_01_publishers",
    "SELECT coalesce(publishername, '—') AS publisher, count(*) AS n FROM papers GROUP BY 1 ORDER BY n DESC, publisher LIMIT 30",
)
def top_publishers(p):
    return m.top_values(p, "publishers", 30)


@over_papers("top_02_subjects", f"{SUBJECT_COUNTS} LIMIT 20", ctes=SUBJECTS)
def top_subjects(p):
    return m.top_values(p, "subjects", 20)


@over_papers(
    "top_03_subjects_by_mean_citations",
    "SELECT subject, count(*) AS papers_count, round(avg(coalesce(citedbycount, 0)), 6) AS avg_cited_by FROM subject_rows "
    "GROUP BY subject ORDER BY avg(coalesce(citedbycount, 0)) DESC, subject LIMIT 20",
    ctes=SUBJECTS,
)
def top_subjects_by_mean_citations(p):
    best = m.subject_stats(p, 20, by="avg_cited_by")
    return best.select("subject", "papers_count", six("avg_cited_by"))


@over_papers(
    "top_04_subjects_by_references",
    "SELECT subject, coalesce(sum(refs), 0.0::DOUBLE) AS value FROM subject_rows GROUP BY subject ORDER BY value DESC, subject LIMIT 20",
    ctes=SUBJECTS,
)
def top_subjects_by_references(p):
    return m.subject_metric(p, "references")


@over_papers(
    "top_05_keywords",
    "SELECT keyword, count(*) AS n FROM keyword_rows GROUP BY keyword ORDER BY n DESC, keyword LIMIT 30",
    ctes=KEYWORDS,
)
def top_keywords(p):
    return m.top_values(p, "keywords", 30)


@over_papers(
    "top_06_funders",
    "SELECT funder, count(*) AS n FROM funder_rows GROUP BY funder ORDER BY n DESC, funder LIMIT 20",
    ctes=FUNDERS,
)
def top_funders(p):
    return m.top_values(p, "funding", m.TOP_FUNDERS)


@over_papers("top_07_subjects_of_one_funder", f"{FUNDED_SUBJECTS} ORDER BY n DESC, subject LIMIT 20", ctes=SUBJECTS)
def top_subjects_of_one_funder(p):
    return m.subjects_funded_by(p, "thon")


TITLE_LABEL = (
    "CASE WHEN length(coalesce(citation_title, '')) >= 60 THEN left(citation_title, 60) || '…' "
    "ELSE coalesce(citation_title, '') END"
)


@over_papers(
    "top_08_cited_papers",
    f"SELECT file_id, citedbycount, {TITLE_LABEL} AS title_short FROM papers "
    "ORDER BY citedbycount DESC NULLS LAST, file_id LIMIT 30",
)
def top_cited(p):
    return m.top_cited(p)


@over_papers(
    "top_09_cited_papers_of_one_subject",
    "SELECT file_id, coalesce(citedbycount, 0) AS cited_by, citation_title, year, sourcetitle FROM papers "
    "WHERE list_contains(subjects, 'thing') ORDER BY cited_by DESC, file_id LIMIT 10",
)
def top_cited_of_one_subject(p):
    return m.top_cited_by_subject(p, "thing")


@over_papers(
    "top_09_cited_papers_of_every_subject",
    "SELECT subject, file_id, cited_by, citation_title, year, sourcetitle, rank FROM (SELECT subject, file_id, "
    "coalesce(citedbycount, 0) AS cited_by, citation_title, year, sourcetitle, CAST(row_number() OVER (PARTITION BY subject "
    "ORDER BY coalesce(citedbycount, 0) DESC, file_id) AS INTEGER) AS rank FROM subject_rows) WHERE rank <= 10",
    ctes=SUBJECTS,
)
def top_cited_of_every_subject(p):
    return m.top_cited_by_subject(p)


JOURNAL_COUNTS = "SELECT sourcetitle AS journal, count(*) AS n FROM papers GROUP BY 1 ORDER BY n DESC, journal"


@over_papers("top_13_journals", f"{JOURNAL_COUNTS} LIMIT 10")
def top_journals(p):
    return m.top_values(p, "journals", 10)


@over_papers("top_15_subjects", f"{SUBJECT_COUNTS} LIMIT 10", ctes=SUBJECTS)
def ten_subjects(p):
    return m.top_values(p, "subjects", 10)


@over_papers(
    "srt_01_funded_by_year",
    "SELECT year, CAST(sum(funding_count) AS BIGINT) AS funders FROM counted WHERE funding_count > 0 GROUP BY year ORDER BY year NULLS LAST",
)
def funded_by_year(p):
    rows = funded(p).groupBy("year").agg(F.sum("funding_count").alias("funders"))
    return rows.orderBy(F.asc_nulls_last("year"))


@over_papers(
    "kpi_of_one_subject",
    "SELECT count(*) AS papers, count(DISTINCT year) AS years_covered, CAST(coalesce(sum(authors_count), 0) AS BIGINT) AS authors_sum, "
    "CAST(coalesce(sum(citedbycount), 0) AS BIGINT) AS cited_by_sum FROM counted WHERE list_contains(subjects, 'thing')",
)
def kpis_of_subject(p):
    return m.kpis(of_subject(p, "thing"))
