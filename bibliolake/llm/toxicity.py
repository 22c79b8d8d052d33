"""Toxicity: embeddings of subwords, averaged over a text, into a linear softmax, both
trained together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import sampled

#: Buckets of subwords, and lengths of the character n-grams of a word with the space
#: on each side; unseen spellings share most of their n-grams with those seen.
BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
#: Characters that stand for letters inside a word.
STAND_INS = "0123456789*@$!|+"


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of the whole text and the share of each. Only letters
    count, in lower case, and what stands for them inside a word; n-grams do not go over
    a space."""
    counts = np.zeros(BUCKETS)
    for piece in chars.pieces(text or "", max(GRAMS) - 1):
        codes = chars.letters_only(piece, STAND_INS)
        space = codes == chars.SPACE
        for n in GRAMS:
            count = len(codes) - n + 1
            if count > 0:
                over = space[1 : 1 + count].copy()
                for i in range(2, n - 1):
                    over |= space[i : i + count]
                buckets = (chars.gram_hashes(codes, n) & np.uint64(BUCKETS - 1)).astype(np.int64)
                counts += np.bincount(buckets[~over], minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found] / max(counts.sum(), 1)


@dataclass
class ToxicityModel:
    """For each bucket how far its embedding moves the softmax to class 1, and the
    bias. The softmax of an average is linear in these, so texts need no more."""

    lean: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        buckets, shares = subwords(text)
        return float(1 / (1 + np.exp(-np.clip(shares @ self.lean[buckets] + self.bias, -500, 500))))


def train(
    sample: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 8, batch: int = 64, rate: float = 0.5, seed: int = 7
) -> ToxicityModel:
    """From ``(label, buckets, shares)``: embeddings and softmax weights by the same
    gradient steps on the cross-entropy, sizes adapted as in AdaGrad."""
    if not sample:
        return ToxicityModel(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weights = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
    labels = np.array([y for y, _, _ in sample])
    prior = (labels.sum() + 1) / (len(labels) + 2)
    bias = np.array([0, np.log(prior / (1 - prior))], np.float32)
    past, past_w = np.full((BUCKETS, 1), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            bags = np.zeros((len(chosen), BUCKETS), np.float32)
            for row, i in enumerate(chosen):
                bags[row, sample[i][1]] = sample[i][2]
            hidden = bags @ embeddings
            logits = hidden @ weights + bias
            chances = np.exp(logits - logits.max(axis=1, keepdims=True))
            chances /= chances.sum(axis=1, keepdims=True)
            chances[np.arange(len(chosen)), labels[chosen]] -= 1
            error = chances / np.float32(len(chosen))
            step, step_w = bags.T @ (error @ weights.T), hidden.T @ error
            past += (step**2).mean(axis=1, keepdims=True)
            past_w += float((step_w**2).mean())
            embeddings -= np.float32(rate) * step / np.sqrt(past)
            weights -= np.float32(0.1 / np.sqrt(past_w)) * step_w
            bias -= np.float32(0.1) * error.sum(axis=0)
    return ToxicityModel((embeddings @ (weights[:, 1] - weights[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, *, rows: int = 8000, id_column: str = "doc_id", text: str = "text", label: str = "toxic"
) -> ToxicityModel:
    """A model from about ``rows`` labelled documents, chosen by a hash of the id;
    ids without a label, or with null, teach nothing, and of several texts for one id the
    smallest does. The chosen ids are few and go to the documents; only subword shares
    reach the driver. Without labelled rows every score is one half."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("label"))
    total = known.count()
    chosen = known.where(sampled(F.lit(min(1.0, rows / max(total, 1))), id_column))
    texts = docs.select(F.col(id_column), F.col(text).alias("text")).join(F.broadcast(chosen), id_column).select(F.col(id_column).alias("id"), "label", "text")
    texts = texts.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for key, y, value in zip(batch["id"], batch["label"], batch["text"]):
                buckets, shares = subwords(value)
                found.append((key, y, buckets.astype(np.uint16).tobytes(), shares.astype(np.float32).tobytes()))
            yield pd.DataFrame(found, columns=["id", "label", "buckets", "shares"])

    kind = texts.schema["id"].dataType.simpleString()
    rows_of = texts.mapInPandas(bags, f"id {kind}, label int, buckets binary, shares binary").collect()
    ordered = sorted(rows_of, key=lambda r: (r["id"], bytes(r["buckets"])))
    return train([(r["label"], np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["shares"], np.float32)) for r in ordered])


def toxicity(model: ToxicityModel, text: str = "text") -> Column:
    """Chance from 0 to 1 that the whole text is toxic."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(F.col(text))


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, score, predicted)`` of every row. Null and empty texts, and those without
    a word, get the score of the bias alone; repeated rows get equal scores; an empty
    table gives none; other columns are not read."""
    rows = docs.select(F.col(id_column), toxicity(model, text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
