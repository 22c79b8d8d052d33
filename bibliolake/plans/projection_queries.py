"""Every attribute of the JSON projection, checked against the papers view the
documents were written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import subject_names
from ..functions.scalars import lenient_int
from ..functions.variants import text_at
from ..operators.projection import build_papers
from ..sources.tables import in_order
from .registry import query
from .tables import PAPERS_SQL, raw_documents, table

JOINED = "array_to_string({0}, '|') AS {1}"


def _joined(column: str | Column, name: str) -> Column:
    return F.array_join(column, "|").alias(name)


def projected(name: str, sql: str, **options):
    """Register a selection of the projected documents."""

    def add(build):
        def run(spark, sf_dir) -> DataFrame:
            return build(build_papers(raw_documents(spark, sf_dir), **options))

        query(name, f"WITH {PAPERS_SQL}\n{sql}")(run)
        return build

    return add


@projected(
    "jsn_01_scalars",
    "SELECT file_id, citation_title, md5(abstracts) AS abstract_md5, publishername, sourcetitle, refcount FROM papers",
)
def scalars(p):
    md5 = F.md5(F.col("abstracts").cast("binary")).alias("abstract_md5")
    return p.select("file_id", "citation_title", md5, "publishername", "sourcetitle", "refcount")


@query(
    "jsn_01_event_property",
    "SELECT event_id, regexp_extract(props, '\"k\": *([0-9]+)', 1) AS k FROM events",
)
def event_property(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return parsed.select("event_id", text_at(F.col("doc"), "k").alias("k"))


@projected("jsn_02_date", "SELECT file_id, publication_date FROM papers")
def date(p):
    return p.select("file_id", "publication_date")


@projected("jsn_03_first_path_that_holds", "SELECT file_id, citedbycount FROM papers")
def cited(p):
    return p.select("file_id", "citedbycount")


@projected("jsn_04_key_at_any_depth", "SELECT file_id, document_classification_codes FROM papers")
def doi(p):
    return p.select("file_id", "document_classification_codes")


@query(
    "jsn_05_lenient_integer",
    "SELECT doc_id, n_chars AS from_prefix, CAST(0 AS BIGINT) AS from_word, -n_chars AS from_decimal FROM documents",
)
def lenient_integers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    number = F.col("n_chars").cast("string")
    return d.select(
        "doc_id",
        lenient_int(F.concat(F.lit("  "), number, "lang")).alias("from_prefix"),
        lenient_int(F.col("lang")).alias("from_word"),
        lenient_int(F.concat(F.lit("-"), number, F.lit(".75"))).alias("from_decimal"),
    )


@projected(
    "jsn_06_array_or_object",
    "SELECT len(keywords) AS n_keywords, len(allauthors_name) AS n_authors, count(*) AS papers FROM papers GROUP BY ALL",
)
def list_sizes(p):
    sizes = p.select(
        F.size("keywords").cast("bigint").alias("n_keywords"),
        F.size("allauthors_name").cast("bigint").alias("n_authors"),
    )
    return sizes.groupBy("n_keywords", "n_authors").agg(F.count("*").alias("papers"))


@projected("jsn_07_authors", f"SELECT file_id, {JOINED.format('allauthors_name', 'authors')} FROM papers")
def authors(p):
    return p.select("file_id", _joined("allauthors_name", "authors"))


@projected(
    "jsn_08_authors_with_degree",
    "SELECT file_id, array_to_string([CASE WHEN x LIKE '%n' THEN 'PhD ' || x ELSE x END for x in allauthors_name], '|') "
    "AS authors FROM papers",
    degree_prefix=True,
)
def authors_with_degree(p):
    return p.select("file_id", _joined("authors_deg_name_json", "authors"))


@projected(
    "jsn_09_subjects",
    "SELECT file_id, array_to_string(list_sort([x || '/' || upper(x[1:4]) for x in subjects]), '|') AS subjects FROM papers",
)
def subjects(p):
    pairs = F.transform("categories", lambda c: F.concat_ws("/", c["subject"], c["abbrev"]))
    return p.select("file_id", _joined(F.array_sort(pairs), "subjects"))


@projected("jsn_10_creator", "SELECT file_id, creator FROM counted")
def creator(p):
    return p.select("file_id", "creator")


@projected(
    "jsn_11_creator_degree",
    "SELECT file_id, CASE WHEN length(creator) % 2 = 0 THEN 'MD' END AS creator_degree FROM counted",
    with_degree="simple",
)
def creator_degree(p):
    return p.select("file_id", "creator_degree")


FALLBACK_SQL = (
    "SELECT file_id, CASE WHEN length(creator) % 2 = 0 THEN 'MD' WHEN creator LIKE '%n' THEN 'PhD' END "
    "AS creator_degree FROM counted"
)


@projected("jsn_12_creator_degree_with_fallback", FALLBACK_SQL, with_degree="fallback")
def creator_degree_with_fallback(p):
    return p.select("file_id", "creator_degree")


projected("join_08_degree_of_same_person", FALLBACK_SQL, with_degree="fallback")(creator_degree_with_fallback)


@projected("jsn_13_keywords", f"SELECT file_id, {JOINED.format('keywords', 'keywords')} FROM papers")
def keywords(p):
    return p.select("file_id", _joined("keywords", "keywords"))


@projected("jsn_14_funders", f"SELECT file_id, {JOINED.format('funding', 'funders')} FROM papers")
def funders(p):
    return p.select("file_id", _joined("funding", "funders"))


projected("set_01_union_of_paths", f"SELECT file_id, {JOINED.format('funding', 'funders')} FROM papers")(funders)


@projected(
    "jsn_15_list_lengths",
    "SELECT file_id, authors_count AS allauthors_count, authors_count, funding_count FROM counted",
)
def list_lengths(p):
    return p.select("file_id", "allauthors_count", "authors_count", "funding_count")


@projected("jsn_16_alias", f"SELECT file_id, {JOINED.format('allauthors_name', 'authors')} FROM papers")
def alias(p):
    return p.select("file_id", _joined("authors_deg_name_json", "authors"))


@projected("jsn_17_order", "SELECT year, file_id FROM papers ORDER BY year NULLS LAST, file_id")
def ordered(p):
    return in_order(p).select("year", "file_id")


@projected(
    "set_03_distinct_pairs",
    "SELECT file_id, len(subjects) AS n_subjects FROM papers",
)
def distinct_pairs(p):
    return p.select("file_id", F.size(subject_names(F.col("categories"))).cast("bigint").alias("n_subjects"))


@projected(
    "exp_04_unnested_authors",
    "SELECT file_id, unnest(allauthors_name) AS author FROM papers",
)
def unnested_authors(p):
    long = p.select("file_id", F.explode_outer("allauthors_name").alias("author"))
    return long.filter(F.col("author").isNotNull())
