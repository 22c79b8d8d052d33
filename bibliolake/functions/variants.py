"""Reading loosely structured JSON held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def allow_repeated_keys(spark: SparkSession) -> None:
    """A repeated key must not lose its document; the last value counts. This sets the
    session, as lazy frames parse when they run: it must still hold then."""
    spark.conf.set(DUPLICATE_KEYS, "true")


def path(*keys: str) -> str:
    """JSON path of nested object keys; the bracket form takes any character."""
    return "$" + "".join(f"['{k}']" for k in keys)


def text_at(v: Column, *keys: str) -> Column:
    return F.try_variant_get(v, path(*keys), "string")


def as_array(v: Column, *keys: str) -> Column:
    """The array at a path; an object counts as one element, all else as none."""
    where = path(*keys)
    single = F.when(
        F.try_variant_get(v, where, "map<string,variant>").isNotNull(),
        F.array(F.try_variant_get(v, where, "variant")),
    )
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(v, where, "array<variant>"), single, empty)


def scalar_at(v: Column, raw: Column, *keys: str) -> Column:
    """Text at a path. A nested value is cut from the raw text, because a
    variant keeps object keys sorted and the source order must survive."""
    where = path(*keys)
    nested = (
        F.try_variant_get(v, where, "map<string,variant>").isNotNull()
        | F.try_variant_get(v, where, "array<variant>").isNotNull()
    )
    return F.when(nested, F.get_json_object(raw, where)).otherwise(text_at(v, *keys))


def first_key_at_any_depth(raw: Column, key: str) -> Column:
    """Scalar value of the first occurrence of a key in document order.

    A quote inside a JSON string is escaped, so the quoted key can only match a
    real key. The first hit decides, also when its value is null.
    """
    hit = rf'"{key}"\s*:\s*("[^"\\]*(?:\\.[^"\\]*)*"|[^\s",\[\]{{}}]+|[\[{{])'
    value = F.regexp_extract(raw, hit, 1)
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(~value.isin("", "[", "{"), text)
