"""Papers and raw documents derived from the test tables.

Each row of ``documents`` is one paper. Lists are words of the whole text that
fit a pattern, so they are made in the row and no list is ever collected from
other rows. The same view is written once more as SQL, as the first common table
expression of every check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns and moduli shared by both forms of the view.
KEYWORD = "[A-Z][a-z]{1,4}"
AUTHOR = "[A-Z][a-z]{5,8}"
FUNDER = "(th|en|er|de|la|ou)(ti|re|an|on|en|ed|th)"
SUBJECT = "[a-z]{2,3}(ing|eau|tion)"
TITLE = r"^[^.\n]*"
# What every 19th reference count is instead of a number, in turn; the one after the last is null.
NO_COUNTS = ("n/a", "NaN", "Infinity", "12d", "1e3", " ", "-Infinity", "3F")
FIRST_DAY, DAY_STEP, DAY_SPAN = "2010-01-01", 37, 4380

PAPERS_SQL = rf"""
words AS (
  SELECT *,
    DATE '{FIRST_DAY}' + CAST((doc_id * {DAY_STEP}) % {DAY_SPAN} AS INTEGER) AS d,
    regexp_extract_all(text, '\p{{L}}+') AS w
  FROM documents
),
papers AS (
  SELECT
    doc_id AS file_id,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(year(d) AS INTEGER) END AS year,
    CASE WHEN doc_id % 23 = 0 THEN NULL ELSE regexp_extract(text, '{TITLE}', 0) END AS citation_title,
    text AS abstracts,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang || ' ' || source END AS publishername,
    source AS sourcetitle,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE strftime(d, '%d/%m/%Y') END AS publication_date,
    '10.5555/' || doc_id AS document_classification_codes,
    CASE WHEN doc_id % 19 = 0 THEN {list(NO_COUNTS)}[(doc_id // 19) % {len(NO_COUNTS) + 1} + 1]
      ELSE CAST(n_chars // 40 AS VARCHAR) END AS refcount,
    CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars // 100 END AS citedbycount,
    [x[1:2] || ' ' || x for x in w if regexp_full_match(x, '{AUTHOR}')] AS allauthors_name,
    list_distinct([x for x in w if regexp_full_match(x, '{SUBJECT}')]) AS subjects,
    [x for x in w if regexp_full_match(x, '{KEYWORD}')] AS keywords,
    [x for x in w if regexp_full_match(x, '{FUNDER}')] AS funding
  FROM words
),
counted AS (
  SELECT *, allauthors_name[1] AS creator,
    CAST(len(allauthors_name) AS INTEGER) AS authors_count,
    CAST(len(funding) AS INTEGER) AS funding_count,
    CASE WHEN regexp_full_match(trim(refcount), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
      THEN TRY_CAST(trim(refcount) AS DOUBLE) END AS refs,
    CAST(try_strptime(publication_date, '%d/%m/%Y') AS DATE) AS pub_day
  FROM papers
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of one piece out to all cores, for work that is heavy per
    row. A table of many pieces, as on a cluster, is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _words(pattern: str) -> Column:
    """All words of the text that fit the pattern as a whole, in order."""
    whole = rf"(?<!\p{{L}}){pattern}(?!\p{{L}})"
    return F.regexp_extract_all("text", F.lit(whole), F.lit(0))


def _unless(divisor: int, value: Column) -> Column:
    return F.when(F.col("doc_id") % divisor != 0, value)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers table, see ``PAPERS_SQL``."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), ((F.col("doc_id") * DAY_STEP) % DAY_SPAN).cast("int"))
    base = spread(table(spark, sf_dir, "documents")).withColumn("d", day)
    names = F.transform(_words(AUTHOR), lambda x: F.concat_ws(" ", F.substring(x, 1, 2), x))
    pairs = F.transform(
        F.array_distinct(_words(SUBJECT)),
        lambda x: F.struct(x.alias("subject"), F.upper(F.substring(x, 1, 4)).alias("abbrev")),
    )
    odd_count = F.get(F.array(*[F.lit(x) for x in NO_COUNTS]), F.expr(f"int(doc_id div 19 % {len(NO_COUNTS) + 1})"))
    wide = base.select(
        F.col("doc_id").alias("file_id"),
        _unless(29, F.year("d")).alias("year"),
        _unless(23, F.regexp_extract("text", TITLE, 0)).alias("citation_title"),
        F.col("text").alias("abstracts"),
        _unless(11, F.concat_ws(" ", "lang", "source")).alias("publishername"),
        F.col("source").alias("sourcetitle"),
        _unless(17, F.date_format("d", "dd/MM/yyyy")).alias("publication_date"),
        F.concat(F.lit("10.5555/"), F.col("doc_id")).alias("document_classification_codes"),
        F.when(F.col("doc_id") % 19 == 0, odd_count).otherwise(F.expr("cast(n_chars div 40 as string)")).alias("refcount"),
        _unless(13, F.expr("n_chars div 100")).alias("citedbycount"),
        names.alias("allauthors_name"),
        pairs.alias("categories"),
        _words(KEYWORD).alias("keywords"),
        _words(FUNDER).alias("funding"),
    )
    return wide.select(
        *wide.columns[:12],
        F.get("allauthors_name", F.lit(0)).alias("creator"),
        "keywords",
        "funding",
        F.col("allauthors_name").alias("authors_deg_name_json"),
        F.size("allauthors_name").alias("allauthors_count"),
        F.size("allauthors_name").alias("authors_count"),
        F.size("funding").alias("funding_count"),
    )


def _one_or_many(items: Column) -> Column:
    """Absent, a bare object or an array, as the input format has it."""
    many = F.parse_json(F.to_json(items))
    one = F.parse_json(F.to_json(F.get(items, F.lit(0))))
    return F.when(F.size(items) > 1, many).when(F.size(items) == 1, one)


def _nest(value: Column, *keys: str) -> Column:
    for key in reversed(keys):
        value = F.struct(value.alias(key))
    return value


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers written back as JSON documents ``(file_id, year, raw_json)``,
    with values spread over all the paths the projection has to try."""
    p = papers(spark, sf_dir)
    turn = F.col("file_id")
    people = F.transform(
        "allauthors_name",
        lambda n: F.struct(
            F.struct(
                F.substring(n, 1, 2).alias("ce:given-name"), n.substr(F.lit(4), F.length(n)).alias("ce:surname")
            ).alias("preferred-name"),
            F.when(n.endswith("n"), F.lit("PhD")).alias("ce:degrees"),
            n.alias("@auid"),
        ),
    )
    creator = F.when(
        F.col("creator").isNotNull(),
        F.struct(
            F.substring("creator", 1, 2).alias("ce:given-name"),
            F.col("creator").substr(F.lit(4), F.length("creator")).alias("ce:surname"),
            F.when(F.length("creator") % 2 == 0, F.lit("MD")).alias("ce:degrees"),
            F.col("creator").alias("@auid"),
        ),
    )
    subjects = F.transform(
        "categories", lambda c: F.struct(c["subject"].alias("$"), c["abbrev"].alias("@abbrev"))
    )
    words = F.transform("keywords", lambda k: F.struct(k.alias("$")))
    half = F.expr("int(size(keywords) / 2)")
    funders = F.transform("funding", lambda f: F.struct(f.alias("xocs:funding-agency-matched-string")))
    cited = F.col("citedbycount").cast("string")
    doi = F.col("document_classification_codes")
    date = F.split("publication_date", "/")
    day = F.when(
        F.col("publication_date").isNotNull(),
        F.struct(F.get(date, F.lit(0)).alias("day"), F.get(date, F.lit(1)).alias("month"), F.get(date, F.lit(2)).alias("year")),
    )
    funding_at = lambda items: _nest(_one_or_many(items), "xocs:funding-list", "xocs:funding")

    head = F.struct(
        F.col("citation_title").alias("citation-title"),
        "abstracts",
        F.struct(
            F.struct("publishername").alias("publisher"), "sourcetitle", day.alias("publicationdate")
        ).alias("source"),
        _nest(_one_or_many(F.slice(words, F.lit(1), half)), "author-keywords", "author-keyword").alias("citation-info"),
        F.struct(_one_or_many(people).alias("author")).alias("author-group"),
    )
    body = F.struct(
        F.struct(
            F.when(turn % 3 == 0, cited).alias("citedby-count"),
            F.when(turn % 2 == 1, F.struct(creator.alias("author"))).alias("dc:creator"),
            _nest(_one_or_many(F.slice(subjects, 1, 1)), "subject-area").alias("subject-areas"),
            _nest(_one_or_many(F.slice(funders, F.lit(2), F.size("funding"))), "xocs:funding").alias("xocs:funding-list"),
        ).alias("coredata"),
        F.struct(
            F.struct(head.alias("head"), _nest(F.col("refcount"), "bibliography", "@refcount").alias("tail")).alias("bibrecord"),
            _nest(F.when(turn % 2 == 0, doi), "itemidlist", "ce:doi").alias("item-info"),
            F.struct(
                F.when(turn % 3 == 1, cited).alias("citedby-count"),
                F.when(turn % 2 == 0, F.struct(creator.alias("author"))).alias("dc:creator"),
            ).alias("coredata"),
            funding_at(F.slice(funders, 1, 1)).alias("xocs:meta"),
        ).alias("item"),
        F.struct(_one_or_many(people).alias("author")).alias("authors"),
        _nest(_one_or_many(subjects), "subject-area").alias("subject-areas"),
        _nest(_one_or_many(F.slice(words, half + 1, F.size("keywords"))), "author-keyword").alias("authkeywords"),
        F.struct(F.when(turn % 2 == 1, doi).alias("ce:doi"), F.when(turn % 3 == 2, cited).alias("citedby-count")).alias("extra"),
    )
    document = F.to_json(F.struct(body.alias("abstracts-retrieval-response")))
    return p.select("file_id", "year", document.alias("raw_json"))
