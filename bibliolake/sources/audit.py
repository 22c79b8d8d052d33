"""Is a table complete, and what is missing in it?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id ranges of the original collection, first and last id per year.
YEAR_RANGES = [
    (2018, 201800000, 201802761),
    (2019, 201900000, 201903081),
    (2020, 202000000, 202003392),
    (2021, 202100000, 202103814),
    (2022, 202200000, 202204243),
    (2023, 202300000, 202302889),
]
ACTIONS = {
    "missing": "load and project",
    "raw": "project",
    "processed_empty": "load and project",
    "processed_incomplete": "load and project",
    "processed": "none",
}
ID_BLOCK = 100_000
#: Tasks for each core that list the ids of blocks.
BLOCK_TASKS = 4


def year_ranges(spark: SparkSession, ranges=YEAR_RANGES) -> DataFrame:
    return spark.createDataFrame(ranges, "year int, start_id bigint, end_id bigint")


def observed_ranges(raw: DataFrame) -> DataFrame:
    """Id range per year as loaded."""
    return (
        raw.filter(F.col("year").isNotNull())
        .groupBy("year")
        .agg(F.min("file_id").alias("start_id"), F.max("file_id").alias("end_id"))
    )


def expected_rows(ranges: DataFrame) -> DataFrame:
    return ranges.select(
        "year", (F.col("end_id") - F.col("start_id") + 1).cast("bigint").alias("expected")
    )


def audit_state(spark: SparkSession, df: DataFrame | None, expected: int) -> DataFrame:
    """One row with state, row count and the action that repairs the table.
    ``None`` stands for a table that does not exist."""
    rows = F.count("*")
    if df is None:
        df, state = spark.range(0), F.lit("missing")
    elif "raw_json" in df.columns:
        state = F.lit("raw")
    else:
        state = (
            F.when(rows == 0, "processed_empty")
            .when(rows != expected, "processed_incomplete")
            .otherwise("processed")
        )
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return df.agg(state.alias("state"), rows.alias("n_rows")).select(
        "state", "n_rows", F.lit(expected).cast("bigint").alias("expected"),
        F.element_at(action, F.col("state")).alias("action"),
    )


def expected_ids(ranges: DataFrame) -> DataFrame:
    """Every id of the ranges. Ranges are cut into blocks first, so no row ever
    holds more than one block. The blocks are dealt to a fixed number of tasks: they are
    small before their ids are listed, so adaptive execution would merge them all."""
    tasks = BLOCK_TASKS * ranges.sparkSession.sparkContext.defaultParallelism
    blocks = ranges.select(
        "year",
        "end_id",
        F.explode(F.sequence("start_id", "end_id", F.lit(ID_BLOCK).cast("bigint"))).alias("lo"),
    ).repartition(tasks)
    hi = F.least(F.col("lo") + ID_BLOCK - 1, F.col("end_id"))
    return blocks.select("year", F.explode(F.sequence("lo", hi)).alias("file_id"))


def missing_ids(raw: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ids inside the ranges without a document."""
    loaded = raw.select("year", "file_id")
    return expected_ids(ranges).join(loaded, ["year", "file_id"], "left_anti")


def loaded_per_year(raw: DataFrame, ranges: DataFrame) -> DataFrame:
    """Expected, loaded and missing documents per year."""
    # No hint: the few rows of a yearly catalogue are broadcast at run time by
    # their size, and a longer one is joined with the hot years split.
    within = F.col("file_id").between(F.col("start_id"), F.col("end_id"))
    inside = raw.join(ranges, "year").filter(within)
    loaded = inside.groupBy("year").agg(F.count_distinct("file_id").alias("loaded"))
    counted = expected_rows(ranges).join(loaded, "year", "left")
    return counted.select(
        "year", "expected", F.coalesce("loaded", F.lit(0)).cast("bigint").alias("loaded")
    ).withColumn("missing", F.col("expected") - F.col("loaded"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, count and percent, most first; one pass over the data."""
    names = df.columns
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names]
    )
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in names]
    )
    share = F.bround(F.try_divide(F.col("e.missing").cast("double"), F.col("_rows")), 4) * 100
    return (
        counted.select("_rows", F.explode(entries).alias("e"))
        .select("e.column", "e.missing", share.alias("missing_pct"))
        .orderBy(F.desc("missing"), "column")
    )


def has_fractions(df: DataFrame, column: str) -> DataFrame:
    """Does any value of the column have a fractional part?"""
    fractional = F.col(column).cast("double") % 1 != 0
    return df.agg(F.coalesce(F.bool_or(fractional), F.lit(False)).alias("has_fractions"))
