"""Filters over papers, and the long frames of their lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import any_contains, subject_names
from ..functions.scalars import not_blank, or_empty, or_missing_label

PUBLISHER_CHOICES = 30


def matches(c: Column, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive search. The pattern is a regular expression and is
    lower-cased before use; ``literal`` searches for the text as it stands."""
    text, wanted = F.lower(or_empty(c)), F.lit(pattern.lower())
    return F.contains(text, wanted) if literal else F.rlike(text, wanted)


def mentions(pattern: str, literal: bool = False) -> Column:
    """Found in the title, the abstract or, as plain text, in some keyword."""
    return (
        matches(F.col("citation_title"), pattern, literal)
        | matches(F.col("abstracts"), pattern, literal)
        | any_contains(F.col("keywords"), pattern)
    )


def cited_between(low: int, high: int, null_as_zero: bool = False) -> Column:
    cited = F.col("citedbycount")
    if null_as_zero:
        return F.coalesce(cited, F.lit(0)).between(low, high)
    return cited.between(low, high) | cited.isNull()


def filter_papers(
    df: DataFrame,
    years: list[int] | None = None,
    publishers: list[str] | None = None,
    source: str | None = None,
    query: str | None = None,
    cited: tuple[int, int] | None = None,
    null_as_zero: bool = False,
    literal: bool = False,
) -> DataFrame:
    """All given conditions at once; ``None`` or a blank text sets no condition.
    A missing publisher is selected as ``—``."""
    conditions = []
    if years is not None:
        conditions.append(F.col("year").isin(years))
    if publishers is not None:
        conditions.append(or_missing_label(F.col("publishername")).isin(publishers))
    if source and source.strip():
        conditions.append(matches(F.col("sourcetitle"), source.strip(), literal))
    if query and query.strip():
        conditions.append(mentions(query.strip(), literal))
    if cited is not None:
        conditions.append(cited_between(*cited, null_as_zero))
    for condition in conditions:
        df = df.filter(condition)
    return df


def of_top_publishers(df: DataFrame, n: int = PUBLISHER_CHOICES) -> DataFrame:
    """Papers of the n most frequent publishers, a missing one counted as ``—``."""
    name = or_missing_label(F.col("publishername"))
    top = df.groupBy(name.alias("_publisher")).count()
    top = top.orderBy(F.desc("count"), "_publisher").limit(n).select("_publisher")
    # No hint: whether so many names are few enough to broadcast is seen at run time.
    return df.join(top, name == top["_publisher"], "left_semi")


def funded(df: DataFrame) -> DataFrame:
    return df.filter(F.col("funding_count") > 0)


def funded_by(df: DataFrame, name: str) -> DataFrame:
    """Papers with a funder whose name contains the text."""
    return df.filter(any_contains(F.col("funding"), name))


def of_subject(df: DataFrame, subject: str) -> DataFrame:
    """Papers having the subject; decided in the row, without a join."""
    return df.filter(F.array_contains(subject_names(F.col("categories")), subject))


def training_rows(df: DataFrame, *parts: Column, journal: str = "sourcetitle") -> DataFrame:
    """Rows with a journal and at least one text part that is not blank. The
    parts are tested rather than the joined text, which is then built once."""
    some_text = reduce(Column.__or__, [not_blank(p) for p in parts])
    return df.filter(not_blank(F.col(journal)) & some_text)


def domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.select(column).dropna().distinct().orderBy(column)


# List attributes of a paper and the name of one element.
ELEMENTS = {
    "subjects": ("categories", "subject"),
    "keywords": ("keywords", "keyword"),
    "funding": ("funding", "funder"),
}


def explode_attr(df: DataFrame, attr: str, keep: list[str]) -> DataFrame:
    """One row per list element, with the columns to keep. Empty lists and empty
    elements give no row."""
    column, name = ELEMENTS[attr]
    values = subject_names(F.col(column)) if attr == "subjects" else F.col(column)
    # The outer form plus filter: for the inner form the optimizer repeats the
    # list expression in a filter of its own and would compute it twice.
    long = df.select(*keep, F.explode_outer(values).alias(name))
    return long.filter(F.col(name) != "")
