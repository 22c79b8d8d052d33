"""Document fingerprints from closed syncmers, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

from .common import id_text, whole

#: Units of a k-mer and of the substrings inside it.
K, S = 5, 2
#: Fixed value: units of texts of every length. Words, in pieces of 8 letters or digits
#: from their start, and single other characters that are no space.
UNIT = r"\p{L}{1,8}+|\p{N}{1,8}+|[^\s\p{L}\p{N}]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is worked out once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _units(text: Column) -> Column:
    return _let(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda u: F.when((F.size(u) == 0) & (F.length(text) > 0), F.array(text)).otherwise(u))


def anchors(text: Column) -> Column:
    """Array of ``struct<place, anchor>``, one for each closed syncmer of the text, in
    order: a k-mer of units whose smallest substring of s units, by hash, is its first
    or its last one. Whether a k-mer is chosen depends on nothing outside it, so equal
    passages have equal anchors wherever they stand. A text without a closed syncmer,
    such as one with fewer units than a k-mer, is one anchor, an empty text none."""
    inner = K - S  # number of the last substring of a k-mer

    def chosen(h: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

        def pick(g: Column) -> Column:
            def one(i: Column) -> Column:
                first, last = F.get(g, i), F.get(g, i + inner)
                least = F.least(*[F.get(g, i + j) for j in range(inner + 1)])
                whole_kmer = F.xxhash64(*[F.get(g, i + j) for j in range(0, inner, S)], last)
                return F.when((first == least) | (last == least), F.struct(i.alias("place"), whole_kmer.alias("anchor")))

            found = F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - K), one), lambda x: x.isNotNull())
            return _let(found, lambda x: F.when(F.size(x) == 0, few).otherwise(x))

        few = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(h).alias("anchor")))
        return F.when(F.size(h) == 0, F.filter(few, lambda x: F.lit(False))).when(F.size(h) < K, few).otherwise(_let(parts, pick))

    return _let(F.transform(_units(text), lambda u: F.xxhash64(u)), chosen)


def sketch(text: Column) -> Column:
    """All anchors in order, repeats included, as 32 bits each that also tell the next
    anchor and how far on it is. So two texts share an entry only where an anchor and
    the next one lie on a common diagonal (place in one text less place in the other)."""

    def linked(found: Column) -> Column:
        def one(a: Column, i: Column) -> Column:
            after = F.get(found, i + 1)
            return F.shiftright(F.xxhash64(a["anchor"], after["anchor"], after["place"] - a["place"]), 32).cast("int")

        return F.transform(found, one)

    return _let(anchors(text), linked)


def as_text(entries: str) -> Column:
    """The digest of a whole sketch, empty for an empty one."""
    listed = F.array_join(F.col(entries).cast("array<string>"), ",")
    return F.when(F.size(entries) == 0, F.lit("")).otherwise(F.sha2(listed.cast("binary"), 256))


def likeness(a: Column, b: Column) -> Column:
    """Matched entries of two sketches as a share of all their entries, a match counted
    once; an entry that occurs n and m times has the smaller number of matches. 1 for
    two empty sketches."""
    # In order of the entry, those of a before those of b.
    together = F.sort_array(F.concat(F.transform(a, lambda x: x.cast("bigint") * 2), F.transform(b, lambda x: x.cast("bigint") * 2 + 1)))
    start = F.struct(F.lit(1 << 40).alias("entry"), F.lit(0).alias("open"), F.lit(0).alias("met"))

    def step(s: Column, x: Column) -> Column:
        entry, second = F.shiftright(x, 1), x.bitwiseAND(F.lit(1)).cast("int")
        waiting = F.when(entry == s["entry"], s["open"]).otherwise(F.lit(0))
        met = s["met"] + F.least(waiting, second)
        return F.struct(entry.alias("entry"), F.greatest(waiting + 1 - 2 * second, F.lit(0)).alias("open"), met.alias("met"))

    met = F.aggregate(together, start, step, lambda s: s["met"])
    every = F.size(a) + F.size(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(_let(met, lambda m: m / (every - m)))


def _following(rows: DataFrame) -> DataFrame:
    """``(key, next_key, n_chars)`` of distinct ``rows (key, id, n_chars)``: the next
    in order of the id, nulls last, after the last the first. Rows are dealt by range
    and only looked at within their part; between parts their first rows do."""
    first = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    dealt = rows.distinct().repartitionByRange(F.col("id").asc_nulls_last(), F.col("key"))
    dealt = through_table(dealt.withColumn("part", F.spark_partition_id()), "order")
    # One row for each part.
    heads = dealt.groupBy("part").agg(F.min(first).alias("head"))
    along = Window.partitionBy(F.lit(0)).orderBy("part")
    around = F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(along), around)["key"].alias("beyond"))
    within = F.lead("key").over(Window.partitionBy("part").orderBy(F.col("id").asc_nulls_last(), "key"))
    return dealt.withColumn("inside", within).join(heads, "part").select("key", F.coalesce("inside", "beyond").alias("next_key"), "n_chars")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, next_id)`` of every row.

    The edited text has its last quarter replaced by as many first characters, or all,
    of the next document by id (ties by a digest of the text, null ids last, after the
    last the first). Null counts as empty. Rows that repeat id and text are one
    document in this order and are all listed; an empty table gives none; other
    columns are not read.
    """
    key = F.md5(F.concat_ws("|", id_text("id"), F.col("id").isNull().cast("string"), "text").cast("binary"))
    rows = docs.select(F.col(id_column).alias("id"), whole(text).alias("text")).withColumn("key", key)
    order = _following(rows.select("key", "id", F.length("text").alias("n_chars")))
    wanted = order.select(F.col("next_key").alias("key"), F.col("key").alias("before"), F.expr("n_chars div 4").cast("int").alias("need"))
    # The same exchange of the texts by key serves both sides.
    heads = rows.join(wanted, "key").groupBy("before").agg(
        F.max(F.substring("text", F.lit(1), F.col("need"))).alias("head"), F.max("id").alias("next_id"), F.first(sketch(F.col("text"))).alias("following")
    )
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.expr("length(text) div 4")).cast("int")), F.col("head"))
    both = rows.join(heads.withColumnRenamed("before", "key"), "key").withColumn("edited", edited)
    sketched = both.select(
        "id", "next_id", "following", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("changed"),
    )
    return sketched.select(
        F.col("id").alias(id_column), "n_chars", "edited_sha256", as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.col("next_id").alias(f"next_{id_column}"),
    )
