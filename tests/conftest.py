import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def papers(spark, sf_dir):
    from bibliolake.plans import tables

    return tables.papers(spark, sf_dir)


PAPER_SCHEMA = """file_id bigint, year int, citation_title string, abstracts string, publishername string,
sourcetitle string, publication_date string, refcount string, citedbycount bigint,
categories array<struct<subject:string,abbrev:string>>, keywords array<string>, funding array<string>,
allauthors_name array<string>, authors_count int, funding_count int"""


@pytest.fixture(scope="session")
def make_papers(spark):
    """Papers from dicts; absent columns are null, absent lists empty."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            lists = {c: row.get(c, []) for c in ("keywords", "funding", "allauthors_name")}
            subjects = [(s, s[:4].upper()) for s in row.get("subjects", [])]
            full.append(
                (
                    row.get("file_id", i), row.get("year"), row.get("citation_title"), row.get("abstracts"),
                    row.get("publishername"), row.get("sourcetitle"), row.get("publication_date"),
                    row.get("refcount"), row.get("citedbycount"), row.get("categories", subjects),
                    lists["keywords"], lists["funding"], lists["allauthors_name"],
                    row.get("authors_count", len(lists["allauthors_name"])),
                    row.get("funding_count", len(lists["funding"])),
                )
            )
        return spark.createDataFrame(full, PAPER_SCHEMA)

    return make
