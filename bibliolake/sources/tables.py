"""The papers table, previews and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import by_year

# Columns of the preview and of the fixed-column export.
PREVIEW_COLUMNS = [
    "year", "publication_date", "citation_title", "publishername", "sourcetitle", "creator",
    "document_classification_codes", "refcount", "citedbycount", "authors_deg_name_json",
    "authors_count", "categories", "keywords",
]
EXPORT_COLUMNS = [
    "year", "publication_date", "citation_title", "publishername", "sourcetitle", "creator",
    "creator_degree", "citedbycount", "refcount", "authors_count", "authors_deg_name_json",
    "categories", "keywords", "document_classification_codes",
]
TRAINING_COLUMNS = ["file_id", "citation_title", "abstracts", "keywords", "sourcetitle"]


def write_papers(papers: DataFrame, where: str) -> None:
    """Replace the papers table, one folder per year, sorted by year and id."""
    by_year(papers).write.mode("overwrite").partitionBy("year").parquet(where)


def read_papers(spark: SparkSession, where: str, columns: list[str] | None = None) -> DataFrame:
    papers = spark.read.parquet(where)
    return papers if columns is None else pick(papers, columns)


def pick(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that exist, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("year"), F.asc_nulls_last("file_id"))


def preview(df: DataFrame, columns: list[str] | None = None, n: int = 200) -> DataFrame:
    """First rows by year and id."""
    return pick(in_order(df).limit(n), PREVIEW_COLUMNS if columns is None else columns)


def flat(df: DataFrame) -> DataFrame:
    """Lists and structs rendered as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema
        ]
    )


def export_csv(df: DataFrame, where: str, columns: list[str] | None = None) -> None:
    """Write UTF-8 CSV with a header; lists become JSON text."""
    chosen = df if columns is None else pick(df, columns)
    writer = flat(chosen).write.mode("overwrite").option("header", True)
    # A blank is a value of its own, not an empty text.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(where)


def read_csv(spark: SparkSession, where: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True)
    return reader.option("quote", '"').option("escape", '"').csv(where)


def count_tables(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Rows of each table of the catalogue."""
    if names is None:
        names = sorted(t.name for t in spark.catalog.listTables())
    counts = [
        spark.table(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        for n in names
    ]
    return reduce(DataFrame.unionByName, counts)


def describe_shape(df: DataFrame) -> DataFrame:
    """One row per column with its type, and the number of rows of the table."""
    described = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
            )
            for i, f in enumerate(df.schema)
        ]
    )
    counted = df.agg(F.count("*").alias("n_rows"))
    return counted.select("n_rows", F.explode(described).alias("c")).select(
        "c.position", "c.column", "c.type", "n_rows"
    )
