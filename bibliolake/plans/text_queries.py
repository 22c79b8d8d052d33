"""Tokens, vocabulary and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as x
from ..operators.impact import with_text
from ..operators.text import TOKEN_PATTERN, term_pipeline
from .registry import over_papers

# Stop words of the checked runs, in both engines.
STOP_WORDS = ["and", "are", "as", "at", "be", "by", "de", "for", "from", "in", "is", "it", "la", "of", "on", "that", "the", "this", "to", "was", "with"]
FEATURES, NGRAM = 400, 2

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS = f"""
texts AS (SELECT file_id, coalesce(citation_title, '') || ' ' || sourcetitle || ' ' || array_to_string(keywords, ' ') || ' '
  || abstracts AS text FROM papers),
tokens AS (SELECT file_id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS words FROM texts),
kept AS (SELECT file_id, [t for t in words if t NOT IN ({STOP_SQL})] AS ws FROM tokens),
grams AS (SELECT file_id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) AS term FROM kept),
counts AS (SELECT file_id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM counts GROUP BY term ORDER BY tf DESC, term LIMIT {FEATURES}),
weighted AS (SELECT c.file_id, c.term, c.tf * (ln((1 + (SELECT count(*) FROM papers)) / (1.0::DOUBLE + v.df)) + 1) AS w
  FROM counts c JOIN vocab v ON c.term = v.term)"""


def terms(p, ngram=NGRAM):
    return term_pipeline(ngram, STOP_WORDS).transform(with_text(p).select("file_id", "text"))


@over_papers(
    "txt_01_tokens",
    "SELECT t AS token, count(*) AS n FROM (SELECT unnest(words) AS t FROM tokens) GROUP BY t",
    ctes=TERMS,
)
def tokens(p):
    tokenizer = term_pipeline(1, STOP_WORDS).stages[0]
    long = tokenizer.transform(with_text(p).select("text")).select(F.explode_outer("words").alias("token"))
    return long.filter("token is not null").groupBy("token").agg(F.count("*").alias("n"))


@over_papers("txt_02_without_stop_words", "SELECT file_id, len(ws) AS n_words FROM kept", ctes=TERMS)
def without_stop_words(p):
    return terms(p, 1).select("file_id", F.size("terms").cast("bigint").alias("n_words"))


@over_papers(
    "txt_03_ngrams",
    "SELECT file_id, greatest(len(ws), 0) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) AS n_terms FROM kept",
    ctes=TERMS,
)
def ngrams(p):
    return terms(p, 3).select("file_id", F.size("terms").cast("bigint").alias("n_terms"))


@over_papers("txt_04_vocabulary", "SELECT term, tf, df FROM vocab", ctes=TERMS)
def vocabulary(p):
    return x.vocabulary_of_words(x.words_of(with_text(p).select("text"), STOP_WORDS), FEATURES, NGRAM)


def fitted(p):
    return x.fit_tfidf(with_text(p), FEATURES, NGRAM, STOP_WORDS)


@over_papers(
    "txt_05_tfidf_weights",
    "SELECT file_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY file_id)), 6) AS weight FROM weighted",
    ctes=TERMS,
)
def tfidf_weights(p):
    model, featured = x.fit_transform_tfidf(with_text(p).select("file_id", "text"), FEATURES, NGRAM, STOP_WORDS)
    return x.weights(featured, model, ["file_id"]).withColumn("weight", F.round("weight", 6))


TITLE_WEIGHTS = f"""
title_tokens AS (SELECT file_id, [t for t in regexp_extract_all(lower(citation_title), '{TOKEN_PATTERN}') if t NOT IN ({STOP_SQL})] AS ws
  FROM papers WHERE citation_title IS NOT NULL),
title_grams AS (SELECT file_id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) AS term FROM title_tokens),
title_weighted AS (SELECT g.file_id, g.term, count(*) * (ln((1 + (SELECT count(*) FROM papers)) / (1.0::DOUBLE + any_value(v.df))) + 1) AS w
  FROM title_grams g JOIN vocab v ON g.term = v.term GROUP BY g.file_id, g.term)"""


@over_papers(
    "txt_06_new_texts",
    "SELECT file_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY file_id)), 6) AS weight FROM title_weighted",
    ctes=f"{TERMS}, {TITLE_WEIGHTS}",
)
def new_texts(p):
    model = fitted(p)
    titles = p.select("file_id", F.col("citation_title").alias("text")).dropna()
    return x.weights(model.transform(titles), model, ["file_id"]).withColumn("weight", F.round("weight", 6))


@over_papers(
    "txt_07_matrix_shape",
    "SELECT (SELECT count(*) FROM papers) AS documents, (SELECT count(*) FROM vocab) AS terms",
    ctes=TERMS,
)
def matrix_shape(p):
    model = fitted(p)
    return x.matrix_shape(model.transform(with_text(p).select("text")), model)
