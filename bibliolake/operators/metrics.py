"""Counts, sums, averages and rankings of papers.

Every grouped aggregate here is partial before its shuffle, so a year, subject
or publisher that holds most rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import list_length, subject_names
from ..functions.scalars import (
    month_label,
    or_empty,
    or_missing_label,
    parse_date,
    ratio_or_null,
    ratio_or_numerator,
    title_label,
    to_count,
    to_number,
)
from ..sources.workspace import through_table
from .selection import ELEMENTS, explode_attr, funded_by, of_subject

TOP_SUBJECTS = 20
TOP_FUNDERS = 20
TOP_CITED = 30
TOP_CITED_PER_SUBJECT = 10


def kpis(df: DataFrame) -> DataFrame:
    """Papers, years covered, sum of authors and of citations."""
    return df.agg(
        F.count("*").alias("papers"),
        F.count_distinct("year").alias("years_covered"),
        F.coalesce(F.sum("authors_count"), F.lit(0)).alias("authors_sum"),
        F.coalesce(F.sum("citedbycount"), F.lit(0)).alias("cited_by_sum"),
    )


def kpis_with_span(df: DataFrame) -> DataFrame:
    """Papers, first and last year, total citations and authors."""
    return df.agg(
        F.count("*").alias("papers"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.coalesce(F.sum("citedbycount"), F.lit(0)).alias("total_citations"),
        F.coalesce(F.sum("authors_count"), F.lit(0)).alias("total_authors"),
    )


def citation_bounds(df: DataFrame) -> DataFrame:
    """Smallest and largest citation count, 0 without any."""
    return df.agg(
        F.coalesce(F.min("citedbycount"), F.lit(0)).alias("low"),
        F.coalesce(F.max("citedbycount"), F.lit(0)).alias("high"),
    )


_YEARLY = {
    "papers": lambda: F.lit(1),
    "authors": lambda: F.col("authors_count"),
    "cited_by": lambda: F.col("citedbycount"),
    "cited_by_or_zero": lambda: F.coalesce("citedbycount", F.lit(0)),
    "references": lambda: to_number(F.col("refcount")),
    "normalized_references": lambda: ratio_or_null(
        to_number(F.col("refcount")),
        F.coalesce("authors_count", F.lit(0)) + F.coalesce("funding_count", F.lit(0)),
    ),
}


def by_year(
    df: DataFrame,
    metric: str = "papers",
    how: str = "sum",
    keep_null_group: bool = True,
    name: str = "value",
) -> DataFrame:
    """Sum or mean of a metric per year. A year without any value gives null.
    Papers without a year form a last row, or are left out."""
    if not keep_null_group:
        df = df.filter(F.col("year").isNotNull())
    value = _YEARLY[metric]()
    summary = {"sum": F.sum, "mean": F.avg}[how](value)
    return df.groupBy("year").agg(summary.alias(name)).orderBy(F.asc_nulls_last("year"))


def by_month(df: DataFrame) -> DataFrame:
    """Papers per calendar month, without undated papers."""
    dated = df.select(parse_date(F.col("publication_date")).alias("d")).filter(F.col("d").isNotNull())
    return (
        dated.groupBy(month_label(F.col("d")).alias("month"))
        .agg(F.count("*").alias("papers"))
        .orderBy("month")
    )


def subject_year(df: DataFrame) -> DataFrame:
    """Papers per year and subject, by year, most papers first."""
    long = explode_attr(df, "subjects", ["year"]).filter(F.col("year").isNotNull())
    counted = long.groupBy("year", "subject").agg(F.count("*").alias("papers"))
    return counted.orderBy("year", F.desc("papers"), "subject")


_PER_SUBJECT = {
    "papers": lambda: F.count("*"),
    "keywords": lambda: F.sum("keyword_count"),
    "references": lambda: F.coalesce(F.sum("refs"), F.lit(0.0)),
}


def subject_metric(df: DataFrame, metric: str = "papers", n: int | None = TOP_SUBJECTS) -> DataFrame:
    """Papers, keywords or references per subject, largest first."""
    rows = df.select(
        "categories",
        list_length(F.col("keywords")).cast("bigint").alias("keyword_count"),
        to_number(F.col("refcount")).alias("refs"),
    )
    long = explode_attr(rows, "subjects", ["keyword_count", "refs"])
    ranked = (
        long.groupBy("subject")
        .agg(_PER_SUBJECT[metric]().alias("value"))
        .orderBy(F.desc("value"), "subject")
    )
    return ranked if n is None else ranked.limit(n)


def subject_stats(df: DataFrame, n: int | None = None, by: str = "papers_count") -> DataFrame:
    """Papers and mean citations (missing as 0) per subject."""
    rows = df.select("categories", F.coalesce("citedbycount", F.lit(0)).alias("cited"))
    stats = (
        explode_attr(rows, "subjects", ["cited"])
        .groupBy("subject")
        .agg(F.count("*").alias("papers_count"), F.avg("cited").alias("avg_cited_by"))
    )
    ranked = stats.orderBy(F.desc(by), "subject")
    return ranked if n is None else ranked.limit(n)


def top_values(df: DataFrame, attr: str, n: int | None, share: bool = False) -> DataFrame:
    """Most frequent subjects, keywords, funders, publishers or journals; ties by
    name. ``share`` adds the percentage among the rows returned."""
    if attr == "publishers":
        long, name = df.select(or_missing_label(F.col("publishername")).alias("publisher")), "publisher"
    elif attr == "journals":
        long, name = df.select(F.col("sourcetitle").alias("journal")).dropna(), "journal"
    else:
        long, name = explode_attr(df, attr, []), ELEMENTS[attr][1]
    ranked = long.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    if n is not None:
        ranked = ranked.limit(n)
    if share:
        # At most n rows are left, so the window without keys is small; all groups are
        # summed up by a plain aggregate.
        total = F.sum("n").over(Window.partitionBy()) if n is not None else ranked.agg(F.sum("n")).scalar()
        ranked = ranked.withColumn("percent", 100.0 * F.col("n") / total)
    return ranked


def subjects_funded_by(df: DataFrame, name: str, n: int | None = TOP_SUBJECTS) -> DataFrame:
    """Subjects of the papers a named agency funded."""
    return top_values(funded_by(df, name), "subjects", n)


def top_cited(df: DataFrame, n: int = TOP_CITED) -> DataFrame:
    """Most cited papers with a short title."""
    ranked = df.orderBy(F.desc_nulls_last("citedbycount"), "file_id").limit(n)
    return ranked.select(
        "file_id", "citedbycount", title_label(F.col("citation_title")).alias("title_short")
    )


def top_cited_by_subject(
    df: DataFrame, subject: str | None = None, n: int = TOP_CITED_PER_SUBJECT
) -> DataFrame:
    """Most cited papers of one subject, or of every subject."""
    cited = F.coalesce("citedbycount", F.lit(0)).alias("cited_by")
    shown = ["citation_title", "year", "sourcetitle"]
    if subject is not None:
        top = of_subject(df, subject).select("file_id", cited, *shown)
        return top.orderBy(F.desc("cited_by"), "file_id").limit(n)
    subjects = F.array_distinct(subject_names(F.col("categories")))
    long = df.select(F.explode_outer(subjects).alias("subject"), "file_id", cited, *shown)
    # The filter on the rank lets each task keep its n best rows per subject
    # before the shuffle, so a subject with most papers stays small there.
    order = Window.partitionBy("subject").orderBy(F.desc("cited_by"), "file_id")
    ranked = long.filter(F.col("subject") != "").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n)


def reference_ratio(df: DataFrame) -> DataFrame:
    """References per author, missing references as 0, no authors as one."""
    ratio = ratio_or_numerator(to_count(F.col("refcount")), F.col("authors_count"))
    return df.select("file_id", ratio.alias("ref_ratio"))


def ratio_histogram(df: DataFrame, width: float) -> DataFrame:
    """Papers per bin of the reference ratio."""
    bin_no = F.floor(F.col("ref_ratio") / width)
    return (
        reference_ratio(df)
        .groupBy(bin_no.alias("bin"))
        .agg(F.count("*").alias("papers"))
        .select((F.col("bin") * width).cast("double").alias("bin_start"), "papers")
        .orderBy("bin_start")
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column, without nulls, most frequent first."""
    counted = df.select(column).dropna().groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column)


def largest_group(df: DataFrame, column: str) -> DataFrame:
    return value_distribution(df, column).agg(F.max("n").alias("largest"))


def n_distinct(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count(column).alias("n_distinct"))


def short_titles(df: DataFrame) -> DataFrame:
    return df.select("file_id", title_label(or_empty(F.col("citation_title"))).alias("title_short"))


#: Bins that a range of values is cut into, the rows that a window sees at most.
_SPAN_BINS = 65_536


def _value_at(counts: DataFrame, rank: int, low: int, high: int) -> tuple[int, bool]:
    """The value with a rank, from 0, among ``counts (v, n)`` between two bounds, and
    whether the next rank has the same value.

    Counts of equal bins tell which bin holds the rank; it is cut into bins again until
    a bin is a single value. Three or four turns are enough for any whole numbers, and
    an outlier that leaves all others in one bin only costs one more.
    """
    while True:
        width = (high - low) // _SPAN_BINS + 1
        inside = counts.filter(F.col("v").between(low, high))
        bins = inside.groupBy(F.expr(f"(cast(v as decimal(20,0)) - {low}BD) div {width}").alias("bin")).agg(F.sum("n").alias("n"))
        up_to = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        placed = bins.select("bin", (up_to - F.col("n")).alias("before"), up_to.alias("end"))
        found = placed.filter((F.col("before") <= rank) & (F.col("end") > rank)).first()
        if width == 1:
            return low + int(found["bin"]), rank + 1 < found["end"]
        low, rank = low + int(found["bin"]) * width, rank - found["before"]
        high = min(high, low + width - 1)


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Linearly interpolated quantile of a whole-number column, as one row; null when
    there is no value. The values are counted and the counts written once, so the input
    is read once; no task ever sorts or holds all the values."""
    values = df.select(F.col(column).cast("bigint").alias("v")).filter(F.col("v").isNotNull())
    counts = through_table(values.groupBy("v").agg(F.count("*").alias("n")), "counts")
    total, low, high = counts.agg(F.sum("n"), F.min("v"), F.max("v")).first()
    if not total:
        return df.sparkSession.createDataFrame([(None,)], "quantile double")
    at = (total - 1) * q
    below, repeated = _value_at(counts, math.floor(at), low, high)
    # The upper of the two ranks needs no search of its own: it is the next value.
    above = below if repeated or at == math.floor(at) else counts.filter(F.col("v") > below).agg(F.min("v")).first()[0]
    return df.sparkSession.createDataFrame([(below + (above - below) * (at - math.floor(at)),)], "quantile double")
