"""Numbers, dates and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the results depend on.
MISSING_LABEL = "—"
ELLIPSIS = "…"
TITLE_WIDTH = 60
DATE_FORMAT = "d/M/yyyy"
NODE_BASE_WEIGHT = 12
NODE_LOG_WEIGHT = 5
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def lenient_int(c: Column) -> Column:
    """Integer prefix of a text; 0 when there is none, null only for null."""
    prefix = F.nullif(F.regexp_extract(F.trim(c), r"^[+-]?[0-9]+", 0), F.lit(""))
    return F.when(c.isNotNull(), F.coalesce(prefix.try_cast("bigint"), F.lit(0).cast("bigint")))


def to_number(c: Column) -> Column:
    """Numeric value of a text in decimal or exponent form, null where it is none.
    Type suffixes, ``NaN`` and infinity in any spelling are no numbers here, nor is
    what exceeds a double: one of them would spoil every sum it enters."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def to_count(c: Column) -> Column:
    """Like ``to_number`` but the result is a whole number, 0 for null and for what
    exceeds a bigint."""
    return F.coalesce(to_number(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def ratio_or_null(num: Column, den: Column) -> Column:
    """Quotient, null for a zero denominator."""
    return F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))


def ratio_or_numerator(num: Column, den: Column) -> Column:
    """Quotient, with a zero denominator read as 1."""
    return num.cast("double") / F.when(den == 0, F.lit(1)).otherwise(den)


def node_weight(freq: Column) -> Column:
    return F.lit(NODE_BASE_WEIGHT) + F.lit(NODE_LOG_WEIGHT) * F.log1p(freq)


def round4(c: Column) -> Column:
    """Four decimals, halves to even."""
    return F.bround(c, 4)


def parse_date(c: Column) -> Column:
    """Day/month/year text as a date, null when it is no calendar day."""
    return F.try_to_date(c, DATE_FORMAT)


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def strip(c: Column) -> Column:
    """Drop whitespace of any kind at both ends (``trim`` only drops spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Every run of whitespace as one blank. Single blanks are left alone, they
    are most of the runs."""
    return F.regexp_replace(c, r"(?U)\s\s+|[\s&&[^ ]]", " ")


def not_blank(c: Column) -> Column:
    """True when there is a character that is not whitespace."""
    return F.coalesce(F.rlike(c, F.lit(r"(?U)\S")), F.lit(False))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_missing_label(c: Column) -> Column:
    return F.coalesce(c, F.lit(MISSING_LABEL))


def title_label(c: Column) -> Column:
    """Chart label of a title: the ellipsis appears from 60 characters on."""
    head = F.substring(or_empty(c), 1, TITLE_WIDTH)
    return F.when(F.length(head) == TITLE_WIDTH, F.concat(head, F.lit(ELLIPSIS))).otherwise(head)


def impact_text(title: Column, journal: Column, keywords: Column, abstract: Column) -> Column:
    """Title, journal, keywords and abstract as one text."""
    return F.concat_ws(
        " ", or_empty(title), or_empty(journal), F.array_join(keywords, " "), or_empty(abstract)
    )


def journal_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """Title, abstract and keywords as one text with single blanks."""
    parts = (or_empty(title), or_empty(abstract), F.array_join(keywords, " "))
    return squeeze(F.concat_ws(" ", *[strip(p) for p in parts]))


def manuscript_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """Non-blank parts of a manuscript joined by blanks, null when all are blank."""
    parts = [F.nullif(strip(or_empty(p)), F.lit("")) for p in (title, abstract, keywords)]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))
