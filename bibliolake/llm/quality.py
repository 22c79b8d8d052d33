"""Quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliolake.sources.workspace import through_table

from . import chars

STATISTICS = [
    "words", "word_length", "length_spread", "letters", "capitals", "digits", "punctuation", "symbols", "variety", "top_word", "top_pair",
    "repeated_lines", "line_length", "plain_words",
]
_PUNCTUATION = np.isin(np.arange(128), [ord(c) for c in ".,;:!?'\"()-"])
_SPACES = np.isin(np.arange(128), [9, 10, 11, 12, 13, 32])


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of the whole text: logarithms of sizes, and the arcsine
    of the root of shares, which spreads those near 0 and 1."""
    text = text or ""
    share = lambda part, whole: np.arcsin(np.sqrt(min(part / whole, 1.0))) if whole else 0.0
    letters = capitals = digits = punctuation = spaces = 0
    for piece in chars.pieces(text, 0):
        codes = chars.code_points(piece)
        flags = chars.flags(codes)
        letters += np.count_nonzero(flags & chars.ALPHA)
        capitals += np.count_nonzero(flags & chars.UPPER)
        digits += np.count_nonzero(flags & chars.DECIMAL)
        low = codes[codes < 128]
        punctuation += np.count_nonzero(_PUNCTUATION[low])
        spaces += np.count_nonzero(_SPACES[low])
    words = text.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line]
    return np.array(
        [
            np.log1p(n),
            np.log1p(sizes.mean()) if n else 0.0,
            np.log1p(sizes.std()) if n else 0.0,
            share(letters, len(text) - spaces),
            share(capitals, letters),
            share(digits, len(text) - spaces),
            share(punctuation, len(text) - spaces),
            share(len(text) - spaces - letters - digits - punctuation, len(text) - spaces),
            np.log1p(len(counts)) / np.log1p(n) if n else 0.0,
            share(max(counts.values(), default=0), n),
            share(max(pairs.values(), default=0), n - 1),
            share(len(lines) - len(set(lines)), len(lines)),
            np.log1p(len(text) / max(len(lines), 1)),
            share(sum(k for w, k in counts.items() if w.isalpha()), n),
        ]
    )


def statistics_column(text: str = "text") -> Column:
    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return measured(F.col(text))


@dataclass
class Gaussian:
    """A class: its mean, the Cholesky factor of its covariance and the logarithm of
    its prior less that of the factor's determinant."""

    mean: np.ndarray
    factor: np.ndarray
    offset: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        # Forward substitution on the factor, for all rows at once.
        z = (x - self.mean).T
        for i, row in enumerate(self.factor):
            z[i] = (z[i] - row[:i] @ z[:i]) / row[i]
        return self.offset - 0.5 * (z**2).sum(axis=0)


@dataclass
class QualityModel:
    classes: list[Gaussian]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1 for each row of statistics."""
        if len(self.classes) < 2:
            return np.full(len(x), 0.5)
        difference = self.classes[1].log_density(x) - self.classes[0].log_density(x)
        return 1 / (1 + np.exp(-np.clip(difference, -500, 500)))


def fit(measured: DataFrame, label: str = "label", values: str = "statistics", shrink: float = 0.1, ridge: float = 0.01) -> QualityModel:
    """A model from all rows with a label 0 or 1.

    Counts, sums and sums of products are partial aggregates, two rows in all. Each
    class covariance is shrunk by ``shrink`` to the pooled one and by ``ridge`` to its
    own mean variance, so that it can be inverted however few the rows. With one class
    only, every score is one half.
    """
    size = len(STATISTICS)
    x = [F.get(values, F.lit(i)) for i in range(size)]
    products = [F.sum(x[i] * x[j]) for i in range(size) for j in range(i + 1)]
    sums = (
        measured.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("sums"), F.array(*products).alias("products"))
        .orderBy("label").collect()
    )
    if len(sums) < 2:
        return QualityModel([])
    total = sum(r["n"] for r in sums)
    lower = np.tril_indices(size)
    means, covariances = [], []
    for r in sums:
        second = np.zeros((size, size))
        second[lower] = r["products"]
        second = second + np.tril(second, -1).T
        mean = np.array(r["sums"]) / r["n"]
        means.append(mean)
        covariances.append(second / r["n"] - np.outer(mean, mean))
    pooled = sum(c * r["n"] for c, r in zip(covariances, sums)) / total
    classes = []
    for r, mean, own in zip(sums, means, covariances):
        mixed = (1 - shrink) * own + shrink * pooled
        mixed = (1 - ridge) * mixed + ridge * (np.trace(mixed) / size + 1e-6) * np.eye(size)
        factor = np.linalg.cholesky(mixed)
        classes.append(Gaussian(mean, factor, float(np.log(r["n"] / total) - np.log(np.diag(factor)).sum())))
    return QualityModel(classes)


def quality(model: QualityModel, values: str = "statistics") -> Column:
    """Chance from 0 to 1 of class 1 from the statistics."""

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(rows.to_numpy()))) if len(rows) else pd.Series([], dtype="float64")

    return score(F.col(values))


def measure(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, statistics)`` of every row, written once: both the model and the scores
    need them."""
    return through_table(docs.select(F.col(id_column), statistics_column(text).alias("statistics")), "statistics")


def labelled(measured: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """The measured rows that have a label; of several for one id the largest."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("label"))
    return measured.join(known, id_column)


def scored(measured: DataFrame, model: QualityModel, threshold: float = 0.7, id_column: str = "doc_id") -> DataFrame:
    """``(id, score, predicted)`` of every measured row. Null and empty texts have
    statistics of 0 and are scored by them; repeated rows get equal scores; an empty
    table gives none."""
    rows = measured.select(id_column, quality(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
