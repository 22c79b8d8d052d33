"""Bring the papers table up to date: load documents and project them as needed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..sources.audit import audit_state
from ..sources.raw import archive_files, document_files, read_raw, split_documents, write_raw
from ..sources.tables import write_papers
from ..sources.workspace import through_table
from .projection import build_papers


def table_or_none(spark: SparkSession, where: str) -> DataFrame | None:
    """The table at a path, None when there is none."""
    try:
        return spark.read.parquet(where)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def collection_state(spark: SparkSession, raw: str, papers: str, expected: int) -> DataFrame:
    """State of the papers table, or of the raw table while there is no other."""
    table = table_or_none(spark, papers)
    if table is None:
        table = table_or_none(spark, raw)
    return audit_state(spark, table, expected)


def refresh(
    spark: SparkSession,
    documents: str,
    raw: str,
    papers: str,
    expected: int,
    zipped: bool = False,
    rejected: str | None = None,
) -> DataFrame:
    """Do what the state of the collection asks for and return the state found
    before. A complete papers table is left alone. Files that are not named like a
    document or do not parse are written to ``rejected``, by default beside the raw
    table, with the reason; the files are read once for both."""
    found = collection_state(spark, raw, papers, expected)
    # One row; kept as values, because the tables it describes are about to change.
    state = found.collect()
    if "load" in state[0]["action"]:
        files = (archive_files if zipped else document_files)(spark, documents)
        docs, others = split_documents(through_table(files, "files"))
        write_raw(docs, raw)
        others.write.mode("overwrite").parquet(rejected or raw.rstrip("/") + "_rejected")
    if "project" in state[0]["action"]:
        write_papers(build_papers(read_raw(spark, raw)), papers)
    return spark.createDataFrame(state, found.schema)
