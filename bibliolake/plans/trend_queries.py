"""Running totals, keyword trends, grids and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trends as t
from .registry import over_papers

YEARS = "yearly AS (SELECT year, count(*) AS papers FROM papers WHERE year IS NOT NULL GROUP BY year)"
MONTHS = (
    "monthly AS (SELECT strftime(pub_day, '%Y-%m') AS month, count(*) AS papers FROM counted "
    "WHERE pub_day IS NOT NULL GROUP BY 1)"
)
# Trend of the top keywords of the last six years, per year and per month.
RECENT = """
last_years AS (SELECT DISTINCT year FROM papers WHERE year IS NOT NULL ORDER BY year DESC LIMIT 6),
recent AS (SELECT year, pub_day, unnest(keywords) AS keyword FROM counted WHERE year IN (SELECT year FROM last_years)),
best AS (SELECT keyword FROM recent GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 8),
year_counts AS (SELECT year AS period, keyword, count(*) AS value FROM recent
  WHERE keyword IN (SELECT keyword FROM best) GROUP BY ALL),
month_counts AS (SELECT date_trunc('month', pub_day) AS period, keyword, count(*) AS value FROM recent
  WHERE keyword IN (SELECT keyword FROM best) AND pub_day IS NOT NULL GROUP BY ALL),
running AS (SELECT period, keyword, CAST(sum(value) OVER (PARTITION BY keyword ORDER BY period) AS BIGINT) AS value FROM year_counts),
year_grid AS (SELECT y.year AS period, b.keyword, coalesce(c.value, 0) AS value FROM last_years y CROSS JOIN best b
  LEFT JOIN year_counts c ON c.period = y.year AND c.keyword = b.keyword),
running_grid AS (SELECT y.year AS period, b.keyword, coalesce(c.value, 0) AS value FROM last_years y CROSS JOIN best b
  LEFT JOIN running c ON c.period = y.year AND c.keyword = b.keyword),
month_grid AS (SELECT m.period, b.keyword, coalesce(c.value, 0) AS value FROM (SELECT DISTINCT period FROM month_counts) m
  CROSS JOIN best b LEFT JOIN month_counts c ON c.period = m.period AND c.keyword = b.keyword),
year_no AS (SELECT year AS period, CAST(row_number() OVER (ORDER BY year) - 1 AS INTEGER) AS no FROM last_years),
month_no AS (SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS INTEGER) AS no FROM (SELECT DISTINCT period FROM month_grid))"""
MONTH_TEXT = "strftime(period, '%Y-%m-%d') AS period"


def dated(df):
    return df.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


YEARLY_RUNNING = (
    "SELECT year, papers, CAST(sum(papers) OVER (ORDER BY year) AS BIGINT) AS cumulative_papers FROM yearly"
)


@over_papers("win_01_papers_running_over_years", YEARLY_RUNNING, ctes=YEARS)
def papers_running_over_years(p):
    return t.literature_trend(p, cumulative=True)


@over_papers("win_02_keywords_running_over_years", "SELECT period, keyword, value FROM running", ctes=RECENT)
def keywords_running_over_years(p):
    return t.keyword_trend(p, "cumulative")


MONTHLY_RUNNING = (
    "SELECT month, papers, CAST(sum(papers) OVER (ORDER BY month) AS BIGINT) AS cumulative_papers FROM monthly"
)


@over_papers("win_03_papers_running_over_months", MONTHLY_RUNNING, ctes=MONTHS)
def papers_running_over_months(p):
    return t.literature_trend(p, "month", cumulative=True)


@over_papers("win_05_recent_years", "SELECT year FROM last_years", ctes=RECENT)
def recent_years(p):
    return t.recent_years(p)


@over_papers("win_06_first_author", "SELECT file_id, allauthors_name[1] AS first_author FROM papers")
def first_author(p):
    return p.select("file_id", F.get("allauthors_name", F.lit(0)).alias("first_author"))


@over_papers("agg_19_keywords_per_year", "SELECT period, keyword, value FROM year_counts", ctes=RECENT)
def keywords_per_year(p):
    return t.keyword_trend(p, "year")


@over_papers("agg_20_keywords_per_month", f"SELECT {MONTH_TEXT}, keyword, value FROM month_counts", ctes=RECENT)
def keywords_per_month(p):
    return dated(t.keyword_trend(p, "month"))


@over_papers("trd_01_literature_per_year", "SELECT year, papers FROM yearly", ctes=YEARS)
def literature_per_year(p):
    return t.literature_trend(p)


over_papers("trd_01_literature_running", YEARLY_RUNNING, ctes=YEARS)(papers_running_over_years)
over_papers("trd_02_literature_per_month", MONTHLY_RUNNING, ctes=MONTHS)(papers_running_over_months)
over_papers("trd_03_keywords_per_year", "SELECT period, keyword, value FROM year_counts", ctes=RECENT)(keywords_per_year)
over_papers("trd_03_keywords_running", "SELECT period, keyword, value FROM running", ctes=RECENT)(
    keywords_running_over_years
)
over_papers("trd_03_keywords_per_month", f"SELECT {MONTH_TEXT}, keyword, value FROM month_counts", ctes=RECENT)(
    keywords_per_month
)
over_papers(
    "join_04_papers_with_top_keywords", "SELECT period, keyword, value FROM year_counts", ctes=RECENT
)(keywords_per_year)


@over_papers("trd_04_year_grid", "SELECT period, keyword, value FROM year_grid", ctes=RECENT)
def year_grid(p):
    return t.keyword_grid(p, "year")


@over_papers("trd_04_running_grid", "SELECT period, keyword, value FROM running_grid", ctes=RECENT)
def running_grid(p):
    return t.keyword_grid(p, "cumulative")


@over_papers("trd_04_month_grid", f"SELECT {MONTH_TEXT}, keyword, value FROM month_grid", ctes=RECENT)
def month_grid(p):
    return dated(t.keyword_grid(p, "month"))


over_papers("join_01_counts_on_grid", "SELECT period, keyword, value FROM year_grid", ctes=RECENT)(year_grid)
over_papers("join_02_grid_of_periods_and_keywords", f"SELECT {MONTH_TEXT}, keyword, value FROM month_grid", ctes=RECENT)(
    month_grid
)


@over_papers(
    "trd_05_year_frames",
    "SELECT f.no AS frame, g.period, g.keyword, g.value FROM year_grid g JOIN year_no f ON g.period <= f.period",
    ctes=RECENT,
)
def year_frames(p):
    return t.frames(t.keyword_grid(p, "year"))


MONTH_FRAMES = (
    "SELECT f.no AS frame, strftime(g.period, '%Y-%m-%d') AS period, g.keyword, g.value FROM month_grid g "
    "JOIN month_no f ON g.period <= f.period"
)


@over_papers("trd_05_month_frames", MONTH_FRAMES, ctes=RECENT)
def month_frames(p):
    return dated(t.frames(t.keyword_grid(p, "month")))


@over_papers(
    "trd_05_month_intervals",
    "SELECT strftime(g.period, '%Y-%m-%d') AS period, g.keyword, g.value, f.no AS first_frame, "
    "CAST((SELECT max(no) FROM month_no) AS INTEGER) AS last_frame FROM month_grid g JOIN month_no f ON g.period = f.period",
    ctes=RECENT,
)
def month_intervals(p):
    return dated(t.frame_intervals(t.keyword_grid(p, "month")))


over_papers("join_03_rows_up_to_each_period", MONTH_FRAMES, ctes=RECENT)(month_frames)
over_papers("set_02_stacked_frames", MONTH_FRAMES, ctes=RECENT)(month_frames)


@over_papers(
    "agg_31_axis_bound",
    "SELECT round(greatest(1.0::DOUBLE, max(value) * 1.05::DOUBLE), 6) AS upper FROM year_grid",
    ctes=RECENT,
)
def axis_bound(p):
    return t.axis_bound(t.keyword_grid(p, "year")).select(F.round("upper", 6).alias("upper"))
