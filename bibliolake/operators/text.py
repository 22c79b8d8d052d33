"""TF-IDF features of texts as a Spark ML pipeline.

Tokens, n-grams, counts and weights are made in the row; fitting shuffles only
partial counts per term, words before n-grams. The driver holds the vocabulary, at
most ``max_features`` terms, and on the way at most twice as many words.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import through_table

# A token is two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Stages of ``term_pipeline`` that cut a text into the words ``kept``.
WORD_STAGES = 3
IMPACT_FEATURES, IMPACT_NGRAM = 5_000, 3
JOURNAL_FEATURES, JOURNAL_NGRAM = 20_000, 2


def term_pipeline(ngram: int, stop_words: list[str] | None = None) -> PipelineModel:
    """``text`` to ``terms``: lower-cased tokens without stop words, and the
    n-grams 2..ngram of what is left."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    grams = [f"gram_{n}" for n in range(2, ngram + 1)]
    joined = ", ".join(["kept", *grams])
    return PipelineModel(
        [
            RegexTokenizer(
                inputCol="text", outputCol="words", pattern=TOKEN_PATTERN, gaps=False
            ),
            StopWordsRemover(inputCol="words", outputCol="kept", stopWords=stop_words),
            SQLTransformer(statement="SELECT * EXCEPT (words) FROM __THIS__"),
            *[NGram(n=n, inputCol="kept", outputCol=g) for n, g in enumerate(grams, start=2)],
            SQLTransformer(
                statement=f"SELECT * EXCEPT ({joined}), concat({joined}) AS terms FROM __THIS__"
            ),
        ]
    )


def term_counts(terms: DataFrame) -> DataFrame:
    """Occurrences ``tf`` and documents ``df`` per term.

    The list of a document is sorted, so a term's first occurrence is where its
    left neighbour differs. One shuffle by term, after partial sums, gives both.
    """
    ordered = terms.select(F.sort_array("terms").alias("t"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))))
    pairs = ordered.select(F.explode_outer(F.arrays_zip(F.col("t").alias("t"), before.alias("b"))).alias("p"))
    rows = pairs.select(F.col("p.t").alias("term"), (~F.col("p.t").eqNullSafe(F.col("p.b"))).alias("first"))
    return (
        rows.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("tf"), F.count_if("first").alias("df"))
    )


def vocabulary(terms: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms of the collection, ties by term."""
    return term_counts(terms).orderBy(F.desc("tf"), "term").limit(max_features)


def frequent_words(words: DataFrame, max_features: int) -> list[str] | None:
    """Words of the lists ``kept`` that can be in a vocabulary of so many terms, alone or in
    an n-gram: those no rarer than the last of as many words, which no n-gram with a rarer
    word can pass. None if there are fewer words, or more than twice as many by ties."""
    long = words.select(F.explode_outer("kept").alias("term")).filter(F.col("term").isNotNull())
    counts = long.groupBy("term").agg(F.count("*").alias("tf"))
    top = counts.orderBy(F.desc("tf"), "term").limit(2 * max_features + 1).collect()
    if not top or len(top) < max_features:
        return None
    frequent = [row["term"] for row in top if row["tf"] >= top[max_features - 1]["tf"]]
    return frequent if len(frequent) <= 2 * max_features else None


def terms_of(words: DataFrame, chosen: list[str], ngram: int) -> DataFrame:
    """``terms``: the chosen words of the lists ``kept`` and the n-grams 2..ngram that hold
    no other word."""
    # Words are letters, digits and underscores. One text of SQL is parsed faster than a
    # column is made for each.
    known = ", ".join(f"'{w}'" for w in chosen)
    grams = words.select(F.expr(f"transform(kept, w -> if(w IN ({known}), w, null))").alias("gram_1"))
    for n in range(2, ngram + 1):
        later = F.slice("gram_1", n, F.greatest(F.size("gram_1") - (n - 1), F.lit(0)))
        joined = F.zip_with(f"gram_{n - 1}", later, lambda a, b: F.concat(a, F.lit(" "), b))
        grams = grams.withColumn(f"gram_{n}", joined)
    return grams.select(F.filter(F.concat(*grams.columns), lambda t: t.isNotNull()).alias("terms"))


def words_of(texts: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``text`` cut into the list ``kept`` of its words without stop words, beside the other
    columns. Written once, about as large as the texts, for all later passes."""
    cut = PipelineModel(term_pipeline(1, stop_words).stages[:WORD_STAGES])
    return through_table(cut.transform(texts).drop("text"), "words")


def vocabulary_of_words(words: DataFrame, max_features: int, ngram: int) -> DataFrame:
    """``vocabulary`` of the n-grams 1..ngram of the lists ``kept``, with the same rows.

    Words are counted first, then only the n-grams of words that are frequent enough for
    the vocabulary, so few of the n-grams of a collection are ever shuffled. Where the
    counts of the words tell nothing, all terms are counted.
    """
    chosen = frequent_words(words, max_features) if ngram > 1 else None
    if chosen is not None:
        return vocabulary(terms_of(words, chosen, ngram), max_features)
    to_terms = PipelineModel(term_pipeline(ngram, []).stages[WORD_STAGES:])
    return vocabulary(to_terms.transform(words.select("kept")), max_features)


def _fit(words: DataFrame, max_features: int, ngram: int, stop_words: list[str] | None) -> PipelineModel:
    chosen = vocabulary_of_words(words, max_features, ngram).collect()
    if not chosen:
        raise ValueError("empty vocabulary: the texts hold only stop words")
    n = words.count()
    idf = [math.log((1 + n) / (1 + row["df"])) + 1 for row in chosen]
    counter = CountVectorizerModel.from_vocabulary(
        [row["term"] for row in chosen], inputCol="terms", outputCol="tf"
    )
    return PipelineModel(
        [
            *term_pipeline(ngram, stop_words).stages,
            counter,
            ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="weighted"),
            Normalizer(p=2.0, inputCol="weighted", outputCol="features"),
            SQLTransformer(statement="SELECT * EXCEPT (terms, tf, weighted) FROM __THIS__"),
        ]
    )


def fit_tfidf(
    df: DataFrame,
    max_features: int = JOURNAL_FEATURES,
    ngram: int = JOURNAL_NGRAM,
    stop_words: list[str] | None = None,
) -> PipelineModel:
    """Fit on the column ``text``; the model adds the unit vector ``features``.

    The weight is tf · (ln((1 + n) / (1 + df)) + 1).
    """
    return _fit(words_of(df.select("text"), stop_words), max_features, ngram, stop_words)


def fit_transform_tfidf(
    df: DataFrame,
    max_features: int = JOURNAL_FEATURES,
    ngram: int = JOURNAL_NGRAM,
    stop_words: list[str] | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """The model of ``fit_tfidf`` and its vectors of the same rows, without ``text``. The
    texts are cut once for both."""
    words = words_of(df, stop_words)
    model = _fit(words, max_features, ngram, stop_words)
    return model, PipelineModel(model.stages[WORD_STAGES:]).transform(words)


def vocabulary_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary


def weights(featured: DataFrame, model: PipelineModel, keys: list[str]) -> DataFrame:
    """Non-zero weights as rows ``(keys, term, weight)``."""
    terms = featured.sparkSession.createDataFrame(
        list(enumerate(vocabulary_of(model))), "index int, term string"
    )
    sparse = featured.select(*keys, F.unwrap_udt("features").alias("u"))
    pairs = F.explode_outer(F.arrays_zip("u.indices", "u.values")).alias("p")
    long = sparse.select(*keys, pairs).select(
        *keys, F.col("p.indices").alias("index"), F.col("p.values").alias("weight")
    )
    # The vocabulary has at most max_features terms.
    return long.join(F.broadcast(terms), "index").select(*keys, "term", "weight")


def matrix_shape(featured: DataFrame, model: PipelineModel) -> DataFrame:
    """Documents and vocabulary size."""
    size = F.lit(len(vocabulary_of(model))).cast("bigint")
    return featured.agg(F.count("*").alias("documents")).select("documents", size.alias("terms"))
