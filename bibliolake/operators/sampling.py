"""Exact stratified splits and folds without sorting a whole label.

Rows are ordered by a hash of their id. The rank at which a label must be cut is
found from counts per hash bucket; only the one bucket holding the cut is sorted.
A label with a third of all rows therefore never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import through_table

TEST_SHARE, SEED, FOLDS = 0.2, 42, 5
BUCKET_DIGITS = 4


def _keyed(df: DataFrame, key: str, seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return df.withColumn("_hash", digest).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))


def _cuts(keyed: DataFrame, label: str, key: str, shares: list[float]) -> DataFrame:
    """Per label and share: hash and id of the last row inside the share. The label, the
    hash and the id are written once for the counts and for the buckets with a cut."""
    keyed = through_table(keyed.select(label, "_bucket", "_hash", key), "ranks")
    histogram = keyed.groupBy(label, "_bucket").agg(F.count("*").alias("n"))
    # At most 16^BUCKET_DIGITS rows per label reach these windows.
    up_to = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = histogram.select(
        label,
        "_bucket",
        "n",
        (F.sum("n").over(up_to) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy(label)).alias("total"),
    )
    wanted = F.posexplode(F.array(*[F.lit(float(s)) for s in shares]))
    ranks = buckets.select("*", wanted.alias("cut", "share")).withColumn(
        "rank", F.floor(F.col("total") * F.col("share"))
    )
    holding = ranks.filter(
        (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n"))
    ).select(label, "_bucket", "cut", (F.col("rank") - F.col("before")).alias("offset"))
    inside = keyed.select(label, "_bucket", "_hash", key)
    inside = inside.join(holding, [label, "_bucket"], "left_semi")
    order = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    ranked = inside.withColumn("offset", F.row_number().over(order))
    return ranked.join(holding, [label, "_bucket", "offset"]).select(
        label, "cut", F.struct("_hash", key).alias("last")
    )


def _below(keyed: DataFrame, label: str, key: str, shares: list[float]) -> DataFrame:
    """Adds ``_passed``: how many cuts of its label lie before each row."""
    cuts = _cuts(keyed, label, key, shares).groupBy(label).agg(
        F.sort_array(F.collect_list("last")).alias("_lasts")
    )
    # One row for each label, written, so that its size is known: few labels are
    # broadcast. With many the join goes by label, and adaptive execution splits a label
    # that holds most of the rows.
    marked = keyed.join(through_table(cuts, "cuts"), label, "left")
    me = F.struct("_hash", key)
    passed = F.coalesce(F.size(F.filter("_lasts", lambda c: c < me)), F.lit(0))
    return marked.withColumn("_passed", passed).withColumn("_found", F.coalesce(F.size("_lasts"), F.lit(0)))


def stratified_split(
    df: DataFrame, label: str, key: str = "file_id", test: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Adds ``is_test``: true for the first ``floor(n · test)`` rows of each
    label in hash order."""
    marked = _below(_keyed(df, key, seed), label, key, [test])
    is_test = (F.col("_found") > 0) & (F.col("_passed") == 0)
    return marked.select(*df.columns, is_test.alias("is_test"))


def stratified_folds(
    df: DataFrame, label: str, key: str = "file_id", folds: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Adds ``fold``: each label is cut into equally many rows per fold."""
    shares = [i / folds for i in range(1, folds)]
    marked = _below(_keyed(df, key, seed), label, key, shares)
    # A label with fewer rows than folds lacks its first cuts.
    lacking = F.lit(folds - 1) - F.col("_found")
    return marked.select(*df.columns, (F.col("_passed") + lacking).cast("int").alias("fold"))

