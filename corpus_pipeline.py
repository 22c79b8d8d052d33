"""A training corpus from ``documents``: language, near copies, benchmark leaks,
secrets and the mix of sources, one stage after the other.

Every stage gets the session, the documents that its predecessor kept and the
folder of the tables, and returns a DataFrame; ``run`` writes each result as
Parquet into the shared folder and reads it again for the next stage. Empty
documents, null texts and texts in no learned language are rejected by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliolake.llm import decontaminate, language, mixing, secrets, similar
from bibliolake.llm.common import in_fold, table
from bibliolake.sources.workspace import through_table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language and is like the texts that it was learned
    from; null texts, texts without a letter, noise and foreign scripts go."""
    return language.keep_identified(docs, language.fit(docs.where(~in_fold(3, 1))))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each group of near copies: five-word
    shingles, a similarity of 0.8 or more."""
    return similar.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` counted anew."""
    masked = secrets.mask(docs, secrets.fit(secrets.labelled_findings(spark)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: ``(doc_id, source, size, source_size, target,
    taken, spans)``; ``mixing.in_order`` puts the spans in the order of the schedule."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", one_of_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

#: The stages are fitted models and searches by hash, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = through_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
