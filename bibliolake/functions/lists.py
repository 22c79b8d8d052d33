"""Lists held in a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import or_empty, strip


def list_length(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def any_contains(c: Column, needle: str) -> Column:
    """True when some element contains the text, ignoring case."""
    return F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), F.lit(needle.lower()))), F.lit(False))


def subject_names(categories: Column) -> Column:
    return F.transform(categories, lambda c: c["subject"])


def distinct_terms(c: Column) -> Column:
    """Sorted distinct elements, stripped, without blanks."""
    stripped = F.transform(c, strip)
    return F.sort_array(F.array_distinct(F.filter(stripped, lambda x: x != "")))


def json_list(c: Column) -> Column:
    """JSON text as a list of texts; anything but a list gives an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_subjects(c: Column) -> Column:
    """Keys of a JSON list of objects, in order; other elements are skipped."""
    objects = F.transform(json_list(c), lambda x: F.from_json(x, "map<string,string>"))
    return F.flatten(F.transform(F.filter(objects, lambda m: m.isNotNull()), lambda m: F.map_keys(m)))


def keywords_as_text(c: Column) -> Column:
    """Keywords stored as JSON list, JSON object or plain text, as one text."""

    def joined(values: Column) -> Column:
        return F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), " ")

    as_list = joined(F.from_json(c, "array<string>"))
    as_values = joined(F.map_values(F.from_json(c, "map<string,string>")))
    return or_empty(F.coalesce(as_list, as_values, c))
