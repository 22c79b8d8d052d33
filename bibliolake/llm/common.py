"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(column: str = "doc_id") -> Column:
    """The id as text; a missing id counts as empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_fold(divisor: int, rest: int, column: str = "doc_id") -> Column:
    """Whether the CRC of the id as text leaves this remainder."""
    return F.crc32(id_text(column).cast("binary")) % divisor == rest


def whole(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def sampled(share: Column, *key: str) -> Column:
    """True for a share of the rows, chosen by a hash of their key, so that a
    second run and a repeated row get the same answer."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < share * float(1 << 30)
