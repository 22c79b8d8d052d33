"""Scans, sinks, catalogue, audit and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lists import subject_names
from ..operators.projection import build_papers
from ..sources import audit, ingest, tables
from ..sources.raw import archive_files, checked_documents, document_files, list_members, read_raw, split_documents, write_raw
from ..sources.workspace import new_path, through_table
from .stored import NAMED_SQL, store_archives, store_files, stored_documents
from .registry import over_papers, query
from .tables import PAPERS_SQL, raw_documents, table

TABLES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]
EXPECTED_ROWS = 20186
VOLUME = 250

FLAT_SQL = """SELECT file_id, year, citation_title, md5(abstracts) AS abstract_md5, publishername, sourcetitle,
  publication_date, document_classification_codes, refcount, citedbycount, creator,
  array_to_string(keywords, '|') AS keywords, array_to_string(funding, '|') AS funding,
  array_to_string(list_sort(subjects), '|') AS subjects, array_to_string(allauthors_name, '|') AS authors,
  authors_count, funding_count FROM counted"""

def flattened(p: DataFrame) -> DataFrame:
    return p.select(
        "file_id", "year", "citation_title", F.md5(F.col("abstracts").cast("binary")).alias("abstract_md5"),
        "publishername", "sourcetitle", "publication_date", "document_classification_codes", "refcount",
        "citedbycount", "creator", F.array_join("keywords", "|").alias("keywords"),
        F.array_join("funding", "|").alias("funding"),
        F.array_join(F.array_sort(subject_names(F.col("categories"))), "|").alias("subjects"),
        F.array_join("allauthors_name", "|").alias("authors"), "authors_count", "funding_count",
    )


over_papers("src_06_full_scan", FLAT_SQL)(flattened)


@over_papers(
    "src_07_pruned_scan",
    "SELECT file_id, citation_title, md5(abstracts) AS abstract_md5, "
    "array_to_string(keywords, '|') AS keywords, sourcetitle FROM papers",
)
def pruned_scan(p):
    chosen = tables.pick(p, tables.TRAINING_COLUMNS)
    return chosen.select(
        "file_id", "citation_title", F.md5(F.col("abstracts").cast("binary")).alias("abstract_md5"),
        F.array_join("keywords", "|").alias("keywords"), "sourcetitle",
    )


@over_papers(
    "src_05_year_ranges",
    "SELECT year, min(file_id) AS start_id, max(file_id) AS end_id FROM papers WHERE year IS NOT NULL GROUP BY year",
)
def year_ranges(p):
    return audit.observed_ranges(p)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored files; every 19th is cut short by its last character."""
    raw = raw_documents(spark, sf_dir)
    whole, broken = F.col("raw_json"), F.expr("left(raw_json, length(raw_json) - 1)")
    files = raw.select(
        F.concat_ws("/", F.lit("archive"), F.coalesce("year", F.lit(2018)), "file_id").alias("path"),
        F.when(F.col("file_id") % 19 == 0, broken).otherwise(whole).alias("value"),
    )
    return through_table(files, "files")


@query(
    "src_01_documents",
    f"WITH {PAPERS_SQL} SELECT file_id, coalesce(year, 2018) AS year, citation_title FROM papers WHERE file_id % 19 <> 0",
)
def documents_read(spark, sf_dir):
    docs, _ = split_documents(_files(spark, sf_dir))
    return build_papers(docs).select("file_id", "year", "citation_title")


@query("src_02_malformed_rejected", f"WITH {PAPERS_SQL} SELECT file_id, 'content' AS reason, false AS whole FROM papers WHERE file_id % 19 = 0")
def malformed_rejected(spark, sf_dir):
    _, rejected = split_documents(_files(spark, sf_dir))
    braces = lambda one: F.regexp_count("raw_json", F.lit(one))
    return rejected.select("file_id", "reason", (braces(r"\{") == braces(r"\}")).alias("whole"))


def _checked(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)
    return checked_documents(files).select(
        "file_id", "year", name.alias("name"), "reason", F.md5(F.col("raw_json").cast("binary")).alias("raw_md5")
    )


@query("src_01_files", NAMED_SQL)
def files_read(spark, sf_dir):
    return _checked(document_files(spark, store_files(stored_documents(spark, sf_dir))))


@query("src_01_archive", NAMED_SQL)
def archive_read(spark, sf_dir):
    return _checked(archive_files(spark, store_archives(stored_documents(spark, sf_dir))))


@query("src_01_ingested_in_two_runs", NAMED_SQL)
def ingested_in_two_runs(spark, sf_dir):
    """One archive, then all of them with the manifest of the first run."""
    stored = store_archives(stored_documents(spark, sf_dir))
    where = new_path(spark, "store")
    one = list_members(spark, stored).agg(F.max("archive")).first()[0]
    for archives in (one, stored) if one else (stored,):
        ingest.ingest(spark, archives, where)
    files = ingest.ingested(spark, where)
    name = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)
    return files.select("file_id", "year", name.alias("name"), "reason", F.md5(F.col("raw_json").cast("binary")).alias("raw_md5"))


def _written_raw(spark: SparkSession, sf_dir: str) -> str:
    where = new_path(spark, "raw")
    write_raw(raw_documents(spark, sf_dir), where)
    return where


@query("src_08_scan_of_one_year", f"WITH {PAPERS_SQL} SELECT file_id, year FROM papers WHERE year = 2015")
def scan_of_one_year(spark, sf_dir):
    return read_raw(spark, _written_raw(spark, sf_dir), 2015).select("file_id", "year")


@query("snk_01_raw_written_and_read", f"WITH {PAPERS_SQL} SELECT file_id, year, true AS same FROM papers")
def raw_written_and_read(spark, sf_dir):
    raw = through_table(raw_documents(spark, sf_dir), "documents")
    where = new_path(spark, "raw")
    write_raw(raw, where)
    digest = F.md5(F.col("raw_json").cast("binary"))
    before = raw.select("file_id", digest.alias("before"))
    after = read_raw(spark, where).select("file_id", "year", digest.alias("after"))
    return after.join(before, "file_id").select("file_id", "year", (F.col("before") == F.col("after")).alias("same"))


@query(
    "snk_02_raw_appended_twice",
    f"WITH {PAPERS_SQL} SELECT file_id, CAST(2 AS BIGINT) AS copies FROM papers",
)
def raw_appended_twice(spark, sf_dir):
    docs = through_table(raw_documents(spark, sf_dir), "documents")
    where = new_path(spark, "raw")
    write_raw(docs, where)
    write_raw(docs, where, mode="append")
    write_raw(docs, where, mode="append", skip_present=True)
    return read_raw(spark, where).groupBy("file_id").agg(F.count("*").alias("copies"))


@query("snk_03_papers_projected_and_written", f"WITH {PAPERS_SQL} {FLAT_SQL}")
def papers_projected_and_written(spark, sf_dir):
    raw = read_raw(spark, _written_raw(spark, sf_dir))
    where = new_path(spark, "papers")
    tables.write_papers(build_papers(raw), where)
    return flattened(tables.read_papers(spark, where))


def _csv_back(p: DataFrame, columns: list[str] | None) -> DataFrame:
    spark = p.sparkSession
    where = new_path(spark, "csv")
    tables.export_csv(p, where, columns)
    names = p.columns if columns is None else [c for c in columns if c in p.columns]
    return tables.read_csv(spark, where, ", ".join(f"`{n}` string" for n in names))


CSV_SQL = """SELECT {key}CAST(year AS VARCHAR) AS year, publication_date, citation_title, publishername, refcount,
  CAST(citedbycount AS VARCHAR) AS citedbycount, {extra}
  '[' || array_to_string(['"' || x || '"' for x in keywords], ',') || ']' AS keywords FROM papers"""


@over_papers(
    "snk_04_csv_all_columns",
    CSV_SQL.format(
        key="CAST(file_id AS VARCHAR) AS file_id, ",
        extra="md5(abstracts) AS abstract_md5, '[' || array_to_string(['\"' || x || '\"' for x in funding], ',') || ']' AS funding,",
    ),
)
def csv_all_columns(p):
    back = _csv_back(p, None)
    return back.select(
        "file_id", "year", "publication_date", "citation_title", "publishername", "refcount", "citedbycount",
        F.md5(F.col("abstracts").cast("binary")).alias("abstract_md5"), "funding", "keywords",
    )


@over_papers("snk_05_csv_fixed_columns", CSV_SQL.format(key="", extra="document_classification_codes,"))
def csv_fixed_columns(p):
    back = _csv_back(p, tables.EXPORT_COLUMNS)
    return back.select(
        "year", "publication_date", "citation_title", "publishername", "refcount", "citedbycount",
        "document_classification_codes", "keywords",
    )


@query(
    "cat_01_table_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
)
def table_counts(spark, sf_dir):
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"counted_{t}")
    counted = tables.count_tables(spark, [f"counted_{t}" for t in TABLES])
    return counted.withColumn("table_name", F.regexp_replace("table_name", "^counted_", ""))


AUDIT_SQL = f"""SELECT s.state, s.n_rows, CAST({EXPECTED_ROWS} AS BIGINT) AS expected,
  CASE WHEN s.state = 'processed' THEN 'none' ELSE 'load and project' END AS action
FROM (SELECT CASE WHEN count(*) = 0 THEN 'processed_empty' WHEN count(*) <> {EXPECTED_ROWS}
  THEN 'processed_incomplete' ELSE 'processed' END AS state, count(*) AS n_rows FROM papers) s"""


@over_papers("aud_01_state", AUDIT_SQL)
def state(p):
    return audit.audit_state(p.sparkSession, p, EXPECTED_ROWS)


# The table is cut into volumes of consecutive ids; a paper without a citation
# count stands for a document that was not delivered.
VOLUMES_SQL = f"volumes AS (SELECT file_id // {VOLUME} AS year, min(file_id) AS lo, max(file_id) AS hi FROM papers GROUP BY 1)"


def _volumes(p: DataFrame) -> DataFrame:
    return p.withColumn("year", F.expr(f"file_id div {VOLUME}"))


@over_papers(
    "aud_02_missing_ids",
    f"SELECT file_id // {VOLUME} AS year, file_id FROM papers WHERE citedbycount IS NULL",
)
def missing_ids(p):
    in_volumes = _volumes(p)
    delivered = in_volumes.filter(F.col("citedbycount").isNotNull())
    return audit.missing_ids(delivered, audit.observed_ranges(in_volumes))


over_papers(
    "join_09_ids_not_loaded",
    f"SELECT file_id // {VOLUME} AS year, file_id FROM papers WHERE citedbycount IS NULL",
)(missing_ids)


@over_papers(
    "aud_02_loaded_per_volume",
    f"SELECT v.year, any_value(v.hi - v.lo + 1) AS expected, count(p.citedbycount) AS loaded, "
    f"any_value(v.hi - v.lo + 1) - count(p.citedbycount) AS missing "
    f"FROM volumes v LEFT JOIN papers p ON p.file_id // {VOLUME} = v.year GROUP BY v.year",
    ctes=VOLUMES_SQL,
)
def loaded_per_volume(p):
    in_volumes = _volumes(p)
    delivered = in_volumes.filter(F.col("citedbycount").isNotNull())
    return audit.loaded_per_year(delivered, audit.observed_ranges(in_volumes))


PROFILED = [
    "file_id", "year", "citation_title", "abstracts", "publishername", "sourcetitle", "publication_date",
    "refcount", "citedbycount", "keywords", "creator",
]


@over_papers(
    "aud_03_missing_profile",
    "SELECT \"column\", missing, round_even(missing / n, 4) * 100 AS missing_pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, CAST(count(*) AS DOUBLE) AS n FROM counted"
        for c in PROFILED
    )
    + ")",
)
def missing_profile(p):
    return audit.missing_profile(p.select(*PROFILED))


@over_papers(
    "aud_04_integral_citations",
    "SELECT coalesce(bool_or(citedbycount % 1 <> 0), false) AS has_fractions FROM papers",
)
def integral_citations(p):
    return audit.has_fractions(p, "citedbycount")


@query(
    "aud_04_fractional_values",
    "SELECT coalesce(bool_or(value % 1 <> 0), false) AS has_fractions FROM events",
)
def fractional_values(spark, sf_dir):
    return audit.has_fractions(table(spark, sf_dir, "events"), "value")


# The pinned columns of the papers table.
SCHEMA = {
    "file_id": "bigint",
    "year": "int",
    "citation_title": "string",
    "abstracts": "string",
    "publishername": "string",
    "sourcetitle": "string",
    "publication_date": "string",
    "document_classification_codes": "string",
    "refcount": "string",
    "citedbycount": "bigint",
    "allauthors_name": "array<string>",
    "categories": "array<struct<subject:string,abbrev:string>>",
    "creator": "string",
    "keywords": "array<string>",
    "funding": "array<string>",
    "authors_deg_name_json": "array<string>",
    "allauthors_count": "int",
    "authors_count": "int",
    "funding_count": "int",
}
SCHEMA_ROWS = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(SCHEMA.items()))


@over_papers(
    "aud_05_shape",
    f"SELECT position, \"column\", type, (SELECT count(*) FROM papers) AS n_rows "
    f"FROM (VALUES {SCHEMA_ROWS}) AS s(position, \"column\", type)",
)
def shape(p):
    return tables.describe_shape(p)


@over_papers(
    "prv_01_preview",
    "SELECT year, publication_date, citation_title, publishername, sourcetitle, creator, "
    "document_classification_codes, refcount, citedbycount, authors_count, "
    "array_to_string(keywords, '|') AS keywords FROM counted ORDER BY year NULLS LAST, file_id LIMIT 200",
)
def first_rows(p):
    shown = tables.preview(p)
    return shown.drop("authors_deg_name_json", "categories").withColumn("keywords", F.array_join("keywords", "|"))
