"""Projections, casts, filters, long frames, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lists import (
    any_contains,
    distinct_terms,
    json_list,
    json_subjects,
    keywords_as_text,
    list_length,
    subject_names,
)
from ..functions.scalars import (
    impact_text,
    journal_text,
    manuscript_text,
    month_label,
    month_start,
    node_weight,
    or_missing_label,
    parse_date,
    ratio_or_null,
    round4,
    squeeze,
    to_count,
    to_number,
)
from ..operators import selection as s
from ..operators.impact import days_from_latest
from ..operators.metrics import reference_ratio, short_titles
from ..operators.network import keyword_nodes
from ..operators.recommend import softmax
from ..sources.tables import numeric_only, pick
from .registry import over_papers




def md5(c):
    return F.md5(c.cast("binary"))


def day_text(c):
    return F.date_format(c, "yyyy-MM-dd")


@over_papers("prj_01_drop_columns", "SELECT file_id, year, publishername, sourcetitle FROM papers")
def drop_columns(p):
    chosen = p.select("file_id", "year", "publishername", "sourcetitle", "creator", "refcount")
    return chosen.drop("creator", "refcount", "creator_degree")


@over_papers(
    "prj_02_numeric_columns",
    "SELECT file_id, year, citedbycount, authors_count AS allauthors_count, authors_count, funding_count FROM counted",
)
def numeric_columns(p):
    return numeric_only(p)


@over_papers("prj_03_number_or_null", "SELECT file_id, refs FROM counted")
def number_or_null(p):
    return p.select("file_id", to_number(F.col("refcount")).alias("refs"))


@over_papers("prj_04_number_or_zero", "SELECT file_id, CAST(coalesce(refs, 0) AS BIGINT) AS refs FROM counted")
def number_or_zero(p):
    return p.select("file_id", to_count(F.col("refcount")).alias("refs"))


@over_papers("prj_05_rename", "SELECT file_id, sourcetitle AS journal FROM papers")
def rename(p):
    return p.select("file_id", "sourcetitle").withColumnRenamed("sourcetitle", "journal")


@over_papers("prj_06_constant", "SELECT file_id, CAST(1 AS INTEGER) AS paper FROM papers")
def constant(p):
    return p.select("file_id", F.lit(1).alias("paper"))


@over_papers("prj_07_present_columns", "SELECT year, sourcetitle, funding_count FROM counted")
def present_columns(p):
    return pick(p, ["year", "authors", "sourcetitle", "funding_count", "ref_list"])


@over_papers("flt_01_years", "SELECT file_id, year FROM papers WHERE year IN (2012, 2015, 2020)")
def years(p):
    return s.filter_papers(p, years=[2012, 2015, 2020]).select("file_id", "year")


@over_papers(
    "flt_02_publishers",
    "SELECT file_id, publishername FROM papers WHERE coalesce(publishername, '—') IN ('—', 'en src3', 'fr src7')",
)
def publishers(p):
    return s.filter_papers(p, publishers=["—", "en src3", "fr src7"]).select("file_id", "publishername")


TOP_PUBLISHERS = (
    "top AS (SELECT coalesce(publishername, '—') AS publisher, count(*) AS n FROM papers "
    "GROUP BY 1 ORDER BY n DESC, publisher LIMIT 30)"
)


@over_papers(
    "flt_03_top_publishers",
    "SELECT file_id, publishername FROM papers WHERE coalesce(publishername, '—') IN (SELECT publisher FROM top)",
    ctes=TOP_PUBLISHERS,
)
def top_publishers(p):
    return s.of_top_publishers(p).select("file_id", "publishername")


@over_papers("flt_04_source_title", "SELECT file_id, sourcetitle FROM papers WHERE regexp_matches(lower(sourcetitle), 'c1[0-4]$')")
def source_title(p):
    return s.filter_papers(p, source=" C1[0-4]$ ").select("file_id", "sourcetitle")


SEARCH = (
    "(regexp_matches(lower(coalesce(citation_title, '')), 'th[ae]n.e') OR regexp_matches(lower(abstracts), 'th[ae]n.e') "
    "OR len([k for k in keywords if contains(lower(k), 'th[ae]n.e')]) > 0)"
)


@over_papers("flt_05_search", f"SELECT file_id FROM papers WHERE {SEARCH}")
def search(p):
    return s.filter_papers(p, query="th[ae]n.E").select("file_id")


@over_papers(
    "flt_05_search_literal",
    "SELECT file_id FROM papers WHERE contains(lower(coalesce(citation_title, '')), 'of.') "
    "OR contains(lower(abstracts), 'of.') OR len([k for k in keywords if contains(lower(k), 'of.')]) > 0",
)
def search_literal(p):
    return s.filter_papers(p, query="of.", literal=True).select("file_id")


@over_papers(
    "flt_06_cited_nulls_kept",
    "SELECT file_id, citedbycount FROM papers WHERE citedbycount BETWEEN 5 AND 40 OR citedbycount IS NULL",
)
def cited_nulls_kept(p):
    return s.filter_papers(p, cited=(5, 40)).select("file_id", "citedbycount")


@over_papers(
    "flt_06_cited_nulls_as_zero",
    "SELECT file_id, citedbycount FROM papers WHERE coalesce(citedbycount, 0) BETWEEN 0 AND 10",
)
def cited_nulls_as_zero(p):
    return s.filter_papers(p, cited=(0, 10), null_as_zero=True).select("file_id", "citedbycount")


@over_papers(
    "flt_07_all_conditions",
    "SELECT file_id FROM papers WHERE year IN (2011, 2013, 2014, 2018, 2020) AND coalesce(publishername, '—') IN "
    "(SELECT publisher FROM top) AND regexp_matches(lower(sourcetitle), 'src1') "
    "AND (regexp_matches(lower(coalesce(citation_title, '')), 'the') OR regexp_matches(lower(abstracts), 'the') "
    "OR len([k for k in keywords if contains(lower(k), 'the')]) > 0) AND (citedbycount BETWEEN 1 AND 60 OR citedbycount IS NULL)",
    ctes=TOP_PUBLISHERS,
)
def all_conditions(p):
    return s.filter_papers(
        s.of_top_publishers(p),
        years=[2011, 2013, 2014, 2018, 2020],
        source="src1",
        query="the",
        cited=(1, 60),
    ).select("file_id")


@over_papers("flt_08_funded", "SELECT file_id, funding_count FROM counted WHERE funding_count > 0")
def funded(p):
    return s.funded(p).select("file_id", "funding_count")


@over_papers(
    "flt_09_funded_by",
    "SELECT file_id FROM papers WHERE len([f for f in funding if contains(lower(f), 'thon')]) > 0",
)
def funded_by(p):
    return s.funded_by(p, "THON").select("file_id")


@over_papers("flt_10_with_citations", "SELECT file_id FROM papers WHERE citedbycount IS NOT NULL")
def with_citations(p):
    return p.dropna(subset=["citedbycount"]).select("file_id")


@over_papers(
    "flt_11_with_date",
    "SELECT file_id, strftime(pub_day, '%Y-%m-%d') AS day FROM counted WHERE pub_day IS NOT NULL",
)
def with_date(p):
    dated = p.select("file_id", parse_date(F.col("publication_date")).alias("d"))
    return dated.filter(F.col("d").isNotNull()).select("file_id", day_text(F.col("d")).alias("day"))


@over_papers(
    "flt_12_training_rows",
    "SELECT file_id FROM papers WHERE trim(coalesce(citation_title, '')) <> '' AND trim(sourcetitle) <> ''",
)
def training_rows(p):
    return s.training_rows(p, F.col("citation_title")).select("file_id")


@over_papers("flt_13_no_empty_elements", "SELECT count(*) AS n FROM (SELECT unnest(funding) AS f FROM papers) WHERE f <> ''")
def no_empty_elements(p):
    return s.explode_attr(p, "funding", []).agg(F.count("*").alias("n"))


@over_papers("exp_01_subjects", "SELECT file_id, year, unnest(subjects) AS subject FROM papers")
def subjects(p):
    return s.explode_attr(p, "subjects", ["file_id", "year"])


@over_papers("exp_02_keywords", "SELECT file_id, year, unnest(keywords) AS keyword FROM papers")
def keywords(p):
    return s.explode_attr(p, "keywords", ["file_id", "year"])


@over_papers("exp_03_funders", "SELECT file_id, unnest(funding) AS funder FROM papers")
def funders(p):
    return s.explode_attr(p, "funding", ["file_id"])


@over_papers(
    "join_05_papers_of_subject",
    "SELECT file_id, year FROM papers WHERE list_contains(subjects, 'thing')",
)
def papers_of_subject(p):
    return s.of_subject(p, "thing").select("file_id", "year")


@over_papers(
    "set_04_distinct_terms",
    "SELECT file_id, array_to_string(list_sort(list_distinct(keywords)), '|') AS terms FROM papers",
)
def terms(p):
    return p.select("file_id", F.array_join(distinct_terms(F.col("keywords")), "|").alias("terms"))


@over_papers("set_05_years", "SELECT DISTINCT year FROM papers WHERE year IS NOT NULL")
def distinct_years(p):
    return s.domain(p, "year")


@over_papers("set_05_subjects", "SELECT DISTINCT unnest(subjects) AS subject FROM papers")
def distinct_subjects(p):
    return s.domain(s.explode_attr(p, "subjects", []), "subject")


@over_papers(
    "str_01_trimmed_concat",
    "SELECT file_id, trim(trim(coalesce(creator, '')) || ' ' || trim(coalesce(publishername, ''))) AS label FROM counted",
)
def trimmed_concat(p):
    parts = [F.trim(F.coalesce(c, F.lit(""))) for c in ("creator", "publishername")]
    return p.select("file_id", F.trim(F.concat_ws(" ", *parts)).alias("label"))


@over_papers("str_02_lower", "SELECT file_id, lower(citation_title) AS title FROM papers")
def lower(p):
    return p.select("file_id", F.lower("citation_title").alias("title"))


@over_papers(
    "str_03_squeeze", r"SELECT file_id, md5(regexp_replace(abstracts, '\s+', ' ', 'g')) AS text_md5 FROM papers"
)
def squeezed(p):
    return p.select("file_id", md5(squeeze(F.col("abstracts"))).alias("text_md5"))


@over_papers(
    "str_04_title_label",
    "SELECT file_id, CASE WHEN length(coalesce(citation_title, '')) >= 60 THEN left(citation_title, 60) || '…' "
    "ELSE coalesce(citation_title, '') END AS title_short FROM papers",
)
def title_labels(p):
    return short_titles(p)


@over_papers("str_05_keyword_text", "SELECT file_id, array_to_string(keywords, ' ') AS keyword_text FROM papers")
def keyword_text(p):
    return p.select("file_id", F.array_join("keywords", " ").alias("keyword_text"))


@over_papers(
    "str_07_impact_text",
    "SELECT file_id, md5(coalesce(citation_title, '') || ' ' || sourcetitle || ' ' || array_to_string(keywords, ' ') || ' ' "
    "|| abstracts) AS text_md5 FROM papers",
)
def impact_texts(p):
    columns = ("citation_title", "sourcetitle", "keywords", "abstracts")
    return p.select("file_id", md5(impact_text(*[F.col(c) for c in columns])).alias("text_md5"))


WHITE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@over_papers(
    "str_07_journal_text",
    "SELECT file_id, md5(regexp_replace("
    + WHITE.format("coalesce(citation_title, '')")
    + " || ' ' || "
    + WHITE.format("abstracts")
    + r" || ' ' || array_to_string(keywords, ' '), '\s+', ' ', 'g')) AS text_md5 FROM papers",
)
def journal_texts(p):
    columns = ("citation_title", "abstracts", "keywords")
    return p.select("file_id", md5(journal_text(*[F.col(c) for c in columns])).alias("text_md5"))


@over_papers(
    "str_08_manuscript_text",
    "SELECT file_id, nullif(concat_ws(' ', nullif(trim(coalesce(citation_title, '')), ''), "
    "nullif(trim(coalesce(publishername, '')), ''), nullif(array_to_string(keywords, ' '), '')), '') AS text FROM papers",
)
def manuscript_texts(p):
    joined = F.array_join("keywords", " ")
    text = manuscript_text(F.col("citation_title"), F.col("publishername"), joined)
    return p.select("file_id", text.alias("text"))


@over_papers("dat_01_parsed_date", "SELECT file_id, strftime(pub_day, '%Y-%m-%d') AS day FROM counted")
def parsed_date(p):
    return p.select("file_id", day_text(parse_date(F.col("publication_date"))).alias("day"))


@over_papers(
    "dat_02_days_from_latest",
    "SELECT file_id, CAST((SELECT max(pub_day) FROM counted) - pub_day AS INTEGER) AS days_from_latest_date FROM counted",
)
def days(p):
    return days_from_latest(p).select("file_id", "days_from_latest_date")


@over_papers(
    "dat_03_month",
    "SELECT file_id, strftime(date_trunc('month', pub_day), '%Y-%m-%d') AS month_start, strftime(pub_day, '%Y-%m') AS month "
    "FROM counted",
)
def months(p):
    day = parse_date(F.col("publication_date"))
    return p.select("file_id", day_text(month_start(day)).alias("month_start"), month_label(day).alias("month"))


@over_papers(
    "mth_01_ratio_or_null",
    "SELECT file_id, round(refs / nullif(authors_count + funding_count, 0), 6) AS ratio FROM counted",
)
def ratios_or_null(p):
    ratio = ratio_or_null(to_number(F.col("refcount")), F.col("authors_count") + F.col("funding_count"))
    return p.select("file_id", F.round(ratio, 6).alias("ratio"))


@over_papers(
    "mth_02_ratio_or_numerator",
    "SELECT file_id, round(coalesce(refs, 0) / CASE WHEN authors_count = 0 THEN 1 ELSE authors_count END, 6) AS ref_ratio FROM counted",
)
def ratios(p):
    return reference_ratio(p).select("file_id", F.round("ref_ratio", 6).alias("ref_ratio"))


@over_papers(
    "mth_03_node_weight",
    "SELECT k AS keyword, round(12 + 5 * ln(1 + count(*)), 6) AS weight FROM "
    "(SELECT file_id, unnest(list_distinct(keywords)) AS k FROM papers) GROUP BY k",
)
def node_weights(p):
    return keyword_nodes(p).select("keyword", F.round(node_weight(F.col("freq")), 6).alias("weight"))


@over_papers(
    "mth_04_round4",
    "SELECT file_id, round_even(CAST(citedbycount AS DOUBLE) / (1 + funding_count), 4) AS r FROM counted",
)
def rounded(p):
    return p.select("file_id", round4(F.col("citedbycount").cast("double") / (1 + F.col("funding_count"))).alias("r"))


@over_papers(
    "mth_05_softmax",
    "SELECT file_id, round(exp(a - m) / s, 6) AS p_authors, round(exp(f - m) / s, 6) AS p_funders FROM ("
    "SELECT *, exp(a - m) + exp(f - m) AS s FROM (SELECT file_id, a, f, greatest(a, f) AS m FROM ("
    "SELECT file_id, authors_count / 10.0::DOUBLE AS a, funding_count / 10.0::DOUBLE AS f FROM counted)))",
)
def softmaxed(p):
    scores = F.array(F.col("authors_count") / 10.0, F.col("funding_count") / 10.0)
    shares = softmax(p.select("file_id", scores.alias("score")), ["file_id"])
    return shares.select(
        "file_id",
        F.round(F.get("probability", F.lit(0)), 6).alias("p_authors"),
        F.round(F.get("probability", F.lit(1)), 6).alias("p_funders"),
    )


@over_papers("arr_01_list_length", "SELECT file_id, CAST(len(keywords) AS INTEGER) AS n FROM papers")
def lengths(p):
    return p.select("file_id", list_length(F.col("keywords")).alias("n"))


@over_papers(
    "arr_02_any_match", "SELECT file_id, len([k for k in keywords if contains(lower(k), 'an')]) > 0 AS hit FROM papers"
)
def any_match(p):
    return p.select("file_id", any_contains(F.col("keywords"), "an").alias("hit"))


@over_papers(
    "arr_03_subject_names", "SELECT file_id, array_to_string(list_sort(subjects), '|') AS subjects FROM papers"
)
def subjects_of(p):
    return p.select("file_id", F.array_join(F.array_sort(subject_names(F.col("categories"))), "|").alias("subjects"))


@over_papers("cnd_01_missing_label", "SELECT file_id, coalesce(publishername, '—') AS publisher FROM papers")
def missing_label(p):
    return p.select("file_id", or_missing_label(F.col("publishername")).alias("publisher"))




@over_papers("str_06_keywords_as_text", "SELECT file_id, array_to_string(keywords, ' ') AS keyword_text FROM papers")
def keywords_of_json(p):
    return p.select("file_id", keywords_as_text(F.to_json("keywords")).alias("keyword_text"))


@over_papers("arr_04_json_list", "SELECT file_id, array_to_string(funding, '|') AS funders, 0 AS from_title FROM papers")
def lists_of_json(p):
    return p.select(
        "file_id",
        F.array_join(json_list(F.to_json("funding")), "|").alias("funders"),
        F.size(json_list(F.col("citation_title"))).alias("from_title"),
    )


@over_papers(
    "arr_03_subject_names_of_json", "SELECT file_id, array_to_string(list_sort(subjects), '|') AS subjects FROM papers"
)
def subjects_of_json(p):
    objects = F.transform("categories", lambda c: F.create_map(c["subject"], c["abbrev"]))
    names = F.array_sort(json_subjects(F.to_json(objects)))
    return p.select("file_id", F.array_join(names, "|").alias("subjects"))
