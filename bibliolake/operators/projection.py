"""Raw JSON documents to one typed row per paper.

Everything happens inside the row: the document is parsed once to VARIANT and
every list is built with higher-order functions, so the projection is one map
stage without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lenient_int
from ..functions.variants import allow_repeated_keys, as_array, first_key_at_any_depth, scalar_at, text_at

# Where the input format keeps each attribute.
ROOT = "abstracts-retrieval-response"
HEAD = ("item", "bibrecord", "head")
TITLE = (*HEAD, "citation-title")
ABSTRACT = (*HEAD, "abstracts")
PUBLISHER = (*HEAD, "source", "publisher", "publishername")
JOURNAL = (*HEAD, "source", "sourcetitle")
DATE = (*HEAD, "source", "publicationdate")
REFERENCE_COUNT = ("item", "bibrecord", "tail", "bibliography", "@refcount")
DOI_KEY = "ce:doi"
DOI = ("item", "item-info", "itemidlist", DOI_KEY)
CITED_KEY = "citedby-count"
CITED = [("coredata", CITED_KEY), ("item", "coredata", CITED_KEY)]
AUTHORS = [("authors", "author")]
SUBJECTS = [
    ("subject-areas", "subject-area"),
    ("item", "coredata", "subject-areas", "subject-area"),
    ("coredata", "subject-areas", "subject-area"),
]
CREATORS = [("item", "coredata", "dc:creator", "author"), ("coredata", "dc:creator", "author")]
KEYWORDS = [
    (*HEAD, "citation-info", "author-keywords", "author-keyword"),
    ("authkeywords", "author-keyword"),
]
FUNDERS = [
    ("item", "xocs:meta", "xocs:funding-list", "xocs:funding"),
    ("xocs:meta", "xocs:funding-list", "xocs:funding"),
    ("xocs:funding-list", "xocs:funding"),
    ("coredata", "xocs:funding-list", "xocs:funding"),
]
FUNDER_NAME = "xocs:funding-agency-matched-string"
AUTHOR_GROUPS = (*HEAD, "author-group")
PREFERRED, GIVEN, SURNAME = "preferred-name", "ce:given-name", "ce:surname"
DEGREE, AUTHOR_ID = "ce:degrees", "@auid"


def _elements(doc: Column, paths: list[tuple[str, ...]]) -> Column:
    """Elements found under all the paths, in path order."""
    return F.concat(*[as_array(doc, ROOT, *p) for p in paths])


def _name_part(person: Column, part: str) -> Column:
    return F.coalesce(text_at(person, PREFERRED, part), text_at(person, part), F.lit(""))


def _full_name(person: Column) -> Column:
    return F.trim(F.concat_ws(" ", _name_part(person, GIVEN), _name_part(person, SURNAME)))


def _tidy_name(person: Column) -> Column:
    return F.trim(
        F.concat_ws(" ", F.trim(_name_part(person, GIVEN)), F.trim(_name_part(person, SURNAME)))
    )


def _name_with_degree(person: Column) -> Column:
    return F.trim(F.concat_ws(" ", text_at(person, DEGREE), _full_name(person)))


def _names(people: Column, name) -> Column:
    return F.filter(F.transform(people, name), lambda n: n != "")


def _names_with_degree(people: Column) -> Column:
    """A degree alone does not make a name."""
    named = F.filter(people, lambda p: _full_name(p) != "")
    return F.transform(named, _name_with_degree)


def _date_text(doc: Column) -> Column:
    day, month, year = (text_at(doc, ROOT, *DATE, part) for part in ("day", "month", "year"))
    complete = day.isNotNull() & month.isNotNull() & year.isNotNull()
    parts = [lenient_int(p) for p in (day, month, year)]
    return F.when(complete, F.format_string("%02d/%02d/%04d", *parts))


def _subjects(doc: Column) -> Column:
    pairs = F.transform(
        _elements(doc, SUBJECTS),
        lambda s: F.struct(text_at(s, "$").alias("subject"), text_at(s, "@abbrev").alias("abbrev")),
    )
    complete = F.filter(pairs, lambda s: s["subject"].isNotNull() & s["abbrev"].isNotNull())
    return F.array_distinct(complete)


def _keywords(doc: Column) -> Column:
    texts = F.transform(_elements(doc, KEYWORDS), lambda k: text_at(k, "$"))
    return F.filter(texts, lambda k: k.isNotNull())


def _funders(doc: Column) -> Column:
    texts = F.transform(_elements(doc, FUNDERS), lambda f: text_at(f, FUNDER_NAME))
    return F.filter(texts, lambda f: F.trim(f) != "")


def _degree(person: Column) -> Column:
    return F.nullif(F.trim(text_at(person, DEGREE)), F.lit(""))


def _degree_of_first_creator(creators: Column) -> Column:
    named = F.filter(creators, lambda p: _full_name(p) != "")
    return text_at(F.get(named, F.lit(0)), DEGREE)


def _degree_with_fallback(doc: Column, creators: Column) -> Column:
    """First creator degree, else that of the same person in an author group."""
    own = F.filter(F.transform(creators, _degree), lambda d: d.isNotNull())
    ids = F.filter(F.transform(creators, lambda p: text_at(p, AUTHOR_ID)), lambda i: i.isNotNull())
    first_id = F.get(ids, F.lit(0))
    members = F.flatten(
        F.transform(as_array(doc, ROOT, *AUTHOR_GROUPS), lambda g: as_array(g, "author"))
    )
    same = F.filter(
        members, lambda p: (text_at(p, AUTHOR_ID) == first_id) & _degree(p).isNotNull()
    )
    return F.coalesce(F.get(own, F.lit(0)), _degree(F.get(same, F.lit(0))))


def build_papers(
    raw: DataFrame, with_degree: str | None = None, degree_prefix: bool = False
) -> DataFrame:
    """Project ``raw(file_id, year, raw_json)`` to the papers schema.

    ``with_degree`` adds ``creator_degree``: ``"simple"`` reads the first named
    creator, ``"fallback"`` also searches the author groups. ``degree_prefix``
    puts the degree before each name in ``authors_deg_name_json``.
    """
    if with_degree not in (None, "simple", "fallback"):
        raise ValueError(f"unknown degree rule: {with_degree}")
    allow_repeated_keys(raw.sparkSession)
    text = F.col("raw_json")
    doc = F.col("doc")
    parsed = raw.select("file_id", "year", "raw_json", F.try_parse_json(text).alias("doc"))

    cited = [text_at(doc, ROOT, *p) for p in CITED]
    columns = {
        "file_id": F.col("file_id").cast("bigint"),
        "year": F.col("year").cast("int"),
        "citation_title": scalar_at(doc, text, ROOT, *TITLE),
        "abstracts": scalar_at(doc, text, ROOT, *ABSTRACT),
        "publishername": scalar_at(doc, text, ROOT, *PUBLISHER),
        "sourcetitle": scalar_at(doc, text, ROOT, *JOURNAL),
        "publication_date": _date_text(doc),
        "document_classification_codes": F.coalesce(
            text_at(doc, ROOT, *DOI), first_key_at_any_depth(text, DOI_KEY)
        ),
        "refcount": scalar_at(doc, text, ROOT, *REFERENCE_COUNT),
        "citedbycount": lenient_int(
            F.coalesce(*cited, first_key_at_any_depth(text, CITED_KEY))
        ),
        "allauthors_name": _names(_elements(doc, AUTHORS), _tidy_name),
        "categories": _subjects(doc),
        "creator": F.get(_names(_elements(doc, CREATORS), _full_name), F.lit(0)),
        "keywords": _keywords(doc),
        "funding": _funders(doc),
    }
    if degree_prefix:
        columns["authors_deg_name_json"] = _names_with_degree(_elements(doc, AUTHORS))
    if with_degree == "simple":
        columns["creator_degree"] = _degree_of_first_creator(_elements(doc, CREATORS))
    elif with_degree == "fallback":
        columns["creator_degree"] = _degree_with_fallback(doc, _elements(doc, CREATORS))

    papers = parsed.select(*[c.alias(name) for name, c in columns.items()])
    if not degree_prefix:
        papers = papers.withColumn("authors_deg_name_json", F.col("allauthors_name"))
    papers = papers.withColumns(
        {
            "allauthors_count": F.size("allauthors_name"),
            "authors_count": F.size("authors_deg_name_json"),
            "funding_count": F.size("funding"),
        }
    )
    order = [
        *list(columns)[:15],
        "authors_deg_name_json",
        "allauthors_count",
        "authors_count",
        "funding_count",
        *(["creator_degree"] if with_degree else []),
    ]
    return papers.select(*order)
