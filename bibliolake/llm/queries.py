"""Registered queries: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontaminate,
    divergence,
    language,
    mixing,
    quality,
    secrets,
    simhash,
    spelling,
    substrings,
    syncmers,
    tokens,
    toxicity,
)
from .common import in_fold, table
from .registry import query


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(3, 1)
    model = language.fit(docs.where(~held_out))
    return docs.select(
        "doc_id", held_out.alias("held_out"), language.language(model).alias("found")
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_mixing", mixing.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "spans")


@query("op2_secrets")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.fit(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


#: Fixed value: the tokenizer that the token counts follow, and their limit.
TOKENIZER, TOKEN_LIMIT = "byte_bpe_50k.json", 512


@query("op4_tokens")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        merges = tokens.Merges.from_json(file.read())
    return tokens.count_tokens(table(spark, sf_dir, "documents"), merges, TOKEN_LIMIT)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~in_fold(4, 2)))
    return toxicity.scored(docs, model).withColumn("held_out", in_fold(4, 2))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents"))
    taught = quality.labelled(measured, table(spark, sf_dir, "labels").where(~in_fold(4, 2)))
    return quality.scored(measured, quality.fit(taught)).withColumn("held_out", in_fold(4, 2))


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_chat", chat.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op11_divergence", divergence.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_substrings", substrings.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


@query("op13_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))
