"""Mixing sources to target weights by a low-discrepancy schedule of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

from .common import WORD, id_text, whole

#: Weights of the sources by their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of a block.
BLOCK = 1024
#: A source's line of documents is laid in 16 ** DIGITS pieces, and a schedule is
#: numbered in pieces of so many slots.
DIGITS, STRETCH = 3, 1 << 16
#: Tasks for each core that list the points of sources.
TASKS = 4


def sized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(id, source, size)``: the words of every row's whole text."""
    return docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), F.regexp_count(whole(text), F.lit(WORD)).cast("bigint").alias("size")
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``(source, source_size, target)``. Sources in order of code points, null last,
    get the weights in turn and share ``percent`` of all words; a target stops at
    ``most`` times its source's words and the excess goes to the others by weight.

    In the order of words for each weight, sources stop first to last. With the k
    first at their limits, the others share the rest at some words for each unit of
    weight; this rate rises as long as a source does stop, and falls once one that
    would not is counted among them. So the rate is the highest over all k, which
    running sums over the sources give without rounds.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over sources only: their number is small and their rows are sums.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = per_source.withColumn("__place", place).withColumn("__w", F.get(cycle, F.col("__place") % len(weights)).cast("bigint"))
    filling = Window.partitionBy(F.lit(0)).orderBy((F.col("source_size") / F.col("__w")), "__place")
    before = F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum("__w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    left = everything * (percent / 100.0) - before
    rates = weighed.withColumn("__rate", left / rest)
    share = F.max("__rate").over(Window.partitionBy(F.lit(0))) * F.col("__w")
    limit = (F.col("source_size") * most).cast("double")
    return rates.select("source", "source_size", F.least(share, limit).alias("target"))


def _bit_reversed(number: Column, bits: Column) -> Column:
    """The van der Corput point of a number of so many bits, in units of 2 ** -bits;
    the same step leads back from a point to its number."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("bigint")


def schedule(quotas: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(slot, source, rank, words)`` from ``quotas (source, quota)``: which source
    each slot of the mix takes a block from, and which of its blocks.

    A source needs as many slots as its quota has blocks, the last one cut. The van
    der Corput points of the numbers below a power of two are equally spaced, so the
    cumulated slots cut them into exactly that many points for each source, and any
    stretch of the schedule holds each source nearly by its weight. Points beyond
    the last source are no slots. A source lists its points in stretches, dealt to
    all tasks, and ranks are counted in stretches, so that a source with most slots
    is neither listed nor numbered by one task. Sources may be many.
    """
    needs = quotas.withColumn("slots", F.ceil(F.col("quota") / block)).where("slots > 0")
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    total = F.sum("slots").over(Window.partitionBy(F.lit(0)))
    bounded = needs.withColumn("high", F.sum("slots").over(order)).withColumn("bits", F.length(F.bin(total - 1)))
    first = F.col("high") - F.col("slots")
    pieces = bounded.select("source", "quota", "high", "bits", F.explode(F.sequence(first, F.col("high") - 1, F.lit(STRETCH).cast("bigint"))).alias("low"))
    # With a number given, adaptive execution does not merge these few bytes again.
    dealt = pieces.repartition(TASKS * quotas.sparkSession.sparkContext.defaultParallelism)
    points = dealt.select("source", "quota", "bits", F.explode(F.sequence("low", F.least(F.col("low") + STRETCH, "high") - 1)).alias("point"))
    slots = points.select(_bit_reversed(F.col("point"), F.col("bits")).alias("slot"), "source", "quota")
    slots = through_table(slots.withColumn("stretch", F.expr(f"slot div {STRETCH}")), "slots")
    counts = slots.groupBy("source", "stretch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("source").alias("__s"), F.col("stretch").alias("__t"), before.alias("offset"))
    near = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    joined = slots.withColumn("near", near).join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("stretch") == F.col("__t")))
    rank = F.col("near") + F.col("offset")
    return joined.select("slot", "source", rank.alias("rank"), F.least(F.lit(block), F.col("quota") - rank * block).cast("bigint").alias("words"))


def laid_out(sizes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The documents of each source, shuffled by the MD5 of the id, on a line of
    words: ``piece`` and ``number`` name a document, ``start`` is its first word.
    Sums run within pieces by the first hex digits of the hash and then over the
    pieces, so that no source is summed up by one task."""
    keyed = sizes.withColumn("hash", F.md5(id_text("id").cast("binary"))).withColumn("piece", F.substring("hash", 1, digits))
    order = Window.partitionBy("source", "piece").orderBy("hash", "size")
    placed = keyed.withColumn("number", F.row_number().over(order)).withColumn(
        "near", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    placed = through_table(placed, "laid")
    pieces = placed.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = pieces.select(F.col("source").alias("__s"), F.col("piece").alias("__p"), before.alias("offset"))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("piece") == F.col("__p")))
    return joined.select("id", "source", "size", "piece", "number", (F.col("near") + F.col("offset")).alias("start"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    percent: int = 150,
    most: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """``(id, source, size, source_size, target, taken, spans)`` of every row: where the
    mix takes words of it and how many, repeats counted.

    ``spans`` are ``(slot, at, start, words)`` in the order of the schedule: slot ``slot``
    holds, from its word ``at`` on, ``words`` words of the row from its word ``start`` on;
    ``taken`` is their sum. A row's list grows with its own text only; ``in_order`` puts
    the spans of all rows together. A slot of rank r takes the block of words r * block onwards of its source's
    line, which begins anew at its end. A source's slots add up to its target,
    rounded down to words, so a document is taken whole in turn and at most ``most``
    times. Null and empty texts have size 0 and are never taken; null is a source of
    its own; a null id is shuffled as empty text; rows with equal id keep their own
    places; an empty table gives none; other columns are not read.
    """
    sizes = through_table(sized(docs, id_column, text, source), "sizes")
    wanted = through_table(targets(sizes, weights, percent, most), "targets")
    slots = schedule(wanted.select("source", F.floor("target").alias("quota")), block).select(
        F.col("source").alias("__s"), F.col("rank").alias("__r"), "slot", "words"
    )
    placed = laid_out(sizes).join(wanted.withColumnRenamed("source", "__w"), F.col("source").eqNullSafe(F.col("__w"))).drop("__w")
    placed = through_table(placed, "placed")
    # The blocks that a document has words in, each time the line is gone through.
    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    at = placed.where("size > 0").withColumn("turn", turns).withColumn("from", F.col("start") + F.col("turn") * F.col("source_size"))
    blocks = at.withColumn("to", F.col("from") + F.col("size")).withColumn(
        "block", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}")))
    )
    met = blocks.join(slots, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__r")))
    begins = F.col("block") * block
    low, high = F.greatest("from", begins), F.least("to", begins + F.col("words"))
    span = F.struct("slot", (low - begins).alias("at"), (low - F.col("from")).alias("start"), (high - low).cast("bigint").alias("words"))
    found = met.where(high > low).groupBy("source", "piece", "number").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    found = found.select(F.col("source").alias("__s"), F.col("piece").alias("__p"), F.col("number").alias("__n"), "spans")
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("piece") == F.col("__p")) & (F.col("number") == F.col("__n"))
    none = F.expr("cast(array() as array<struct<slot:bigint,at:bigint,start:bigint,words:bigint>>)")
    joined = placed.join(found, same, "left").withColumn("spans", F.coalesce("spans", none))
    taken = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["words"])
    return joined.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", taken.alias("taken"), "spans")


def in_order(mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(slot, at, id, source, start, words)`` of the result of ``mix``, sorted as the
    schedule has it: the mix itself, to be read from the first slot to the last."""
    spans = mixed.select(id_column, "source", F.explode("spans").alias("span"))
    return spans.select("span.slot", "span.at", id_column, "source", "span.start", "span.words").orderBy("slot", "at")


#: The same mix without a schedule: the first words of the doubled line, up to the target.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents
),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums
),
shares AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM weighed
),
filled AS (
  SELECT *,
    sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
      - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM shares
),
wanted AS (
  SELECT source, source_size, least(max(CAST(rest AS DOUBLE) / rest_w) OVER () * w, CAST(2 * source_size AS DOUBLE)) AS target FROM filled
),
lines AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY hash, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM sized
)
SELECT l.doc_id, l.size, t.source_size, t.target,
  CAST(least(greatest(floor(target) - start, 0), size) + least(greatest(floor(target) - start - t.source_size, 0), size) AS BIGINT) AS taken
FROM lines l JOIN wanted t ON l.source IS NOT DISTINCT FROM t.source
"""
