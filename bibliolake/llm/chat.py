"""Chat formatting: logged conversations that are the beginning of longer ones are
left out before the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

#: Turns that are rendered together.
PART = 1024
#: The marks around a turn, and how they are written inside a text.
START, END, MARK, PLAIN = "<|im_start|>", "<|im_end|>", "<|im_", "< |im_"


def _hash(salt: int) -> Column:
    """A hash of the turn at its place. Nulls are told from empty texts."""
    return F.xxhash64(F.lit(salt), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def prefixes(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, stretch, place, role, text, a, b, n_turns)``: every turn at its place from 1 and
    two hashes of the conversation up to there.

    A prefix hash combines the hashes of its turns, each salted with its place, by
    exclusive or. All rows are dealt by ranges of conversation, turn, role and text;
    turns are numbered and combined in the stretch of a conversation within a range and
    then over its stretches, so that no conversation is gone through by one task, whatever
    its turn numbers are.
    """
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    ).distinct()
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    rows = rows.repartitionByRange(*order).withColumn("stretch", F.spark_partition_id())
    near = Window.partitionBy("conv", "stretch").orderBy("turn", "role", "text")
    rows = through_table(rows.withColumn("near", F.row_number().over(near)), "turns")
    along = Window.partitionBy("conv").orderBy("stretch")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv", "stretch").agg(F.count("*").alias("n"))
    counts = counts.select(
        F.col("conv").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy("conv")).alias("n_turns"),
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))
    placed = rows.join(counts, same).drop("c", "s").withColumn("place", F.col("near") + F.col("offset"))
    placed = placed.withColumns({"ha": _hash(1), "hb": _hash(2)})
    sums = placed.groupBy("conv", "stretch").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    upto = near.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    sums = sums.select(
        F.col("conv").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.bit_xor("ha").over(before), zero).alias("pa"),
        F.coalesce(F.bit_xor("hb").over(before), zero).alias("pb"),
    )
    within = placed.withColumns({"a": F.bit_xor("ha").over(upto), "b": F.bit_xor("hb").over(upto)})
    joined = within.join(sums, same)
    return joined.select(
        "conv", "stretch", "place", "role", "text", F.col("a").bitwiseXOR(F.col("pa")).alias("a"), F.col("b").bitwiseXOR(F.col("pb")).alias("b"), "n_turns"
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv)`` of the conversations that no longer one begins with; of equal ones
    the smallest, an id that is null after all others."""
    ends = turns.where("place = n_turns").groupBy("a", "b", "place").agg(F.min("conv").alias("conv"))
    inside = turns.where("place < n_turns").select("a", "b", "place").distinct()
    return ends.join(inside, ["a", "b", "place"], "left_anti").select("conv")


def render(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, part, n_turns, rendered)`` of the maximal conversations, in parts of
    at most ``PART`` turns: nearly always one, while a huge one becomes several rows.

    Rows that repeat a turn count once; several texts for one turn number follow each
    other in order of role and text; a null turn number comes first; a null id is one
    conversation; a null role is written ``unknown`` and a null text empty. Marks
    inside a text are written so that they are none. An empty table gives none; other
    columns are not read.
    """
    turns = through_table(prefixes(conversations, conv, turn, role, text), "prefixes")
    kept = maximal(turns).select(F.col("conv").alias("c"))
    body = F.concat(
        F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(PLAIN)), F.lit(END + "\n")
    )
    rows = turns.join(kept, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select(
        "conv", F.floor((F.col("place") - 1) / PART).alias("part"), "n_turns", F.struct("place", body.alias("body")).alias("turn")
    )
    parts = rows.groupBy("conv", "part").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return parts.select(F.col("conv").alias(conv), "part", "n_turns", F.concat_ws("", "turns.body").alias("rendered"))


#: The same with whole conversations as lists.
SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM turns
),
lists AS (
  SELECT conv_id, count(*) AS n_turns, list(md5(coalesce('r' || role, 'n') || chr(30) || coalesce('t' || text, 'n')) ORDER BY place) AS l
  FROM placed GROUP BY conv_id
),
begun AS (
  SELECT DISTINCT array_to_string(l[1:i], ' ') AS p FROM (SELECT l, unnest(range(1, n_turns)) AS i FROM lists)
),
kept AS (
  SELECT min(conv_id) AS conv_id FROM lists WHERE array_to_string(l, ' ') NOT IN (SELECT p FROM begun) GROUP BY l
)
SELECT p.conv_id, CAST((place - 1) // {PART} AS BIGINT) AS part, CAST(max(l.n_turns) AS BIGINT) AS n_turns,
  string_agg('{START}' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '{MARK}', '{PLAIN}') || '{END}' || chr(10), '' ORDER BY place) AS rendered
FROM placed p JOIN kept k ON p.conv_id IS NOT DISTINCT FROM k.conv_id JOIN lists l ON p.conv_id IS NOT DISTINCT FROM l.conv_id
GROUP BY p.conv_id, (place - 1) // {PART}
"""
