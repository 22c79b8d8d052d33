"""Language identification in two steps: the language family first, then linear
support vector machines for each pair of languages within it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chars
#: Families of common languages; any other forms its own family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("pl", "cs", "ru", "uk", "sk", "bg"),
}
UNKNOWN = "und"
#: Share of the least likeness of learned texts that others must reach. Texts that repeat
#: one word are the least alike; at 0.8 some of those held out would fall below it.
SLACK = 0.5


def family_of(lang: str, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((name for name, members in families.items() if lang in members), lang)


def features(text: str, dim: int) -> np.ndarray | None:
    """Square roots of the shares of hashed n-grams of 1 to 3 letters of the whole
    text, a vector of length 1; None for a text without a letter."""
    return weighed(text, dim)[0]


def weighed(text: str, dim: int) -> tuple[np.ndarray | None, int]:
    """The vector of ``features`` and how many n-grams it stands for."""
    counts = np.zeros(dim)
    for piece in chars.pieces(text, 2):
        codes = chars.letters_only(piece)
        if len(codes) < 2:
            continue
        for n in (1, 2, 3):
            buckets = (chars.gram_hashes(codes, n) % np.uint64(dim)).astype(np.int64)
            counts += np.bincount(buckets[codes[: len(buckets)] != chars.SPACE] if n == 1 else buckets, minlength=dim)
    total = counts.sum()
    return (np.sqrt(counts / total).astype(np.float32) if total else None), int(total)


def length_class(n: int) -> int:
    """Texts of 4 ** c up to below 4 ** (c + 1) n-grams are of class c."""
    return (n.bit_length() - 1) // 2


def _svm(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Weights, the last one the bias, of a linear machine with squared hinge loss,
    y in -1, 1 and both classes weighing the same; accelerated gradient steps."""
    # Single precision throughout: mixed types would copy the matrix in each step.
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    # Vectors have length 1, with the bias sqrt(2), so the curvature is at most 4.
    rate, penalty = np.float32(1 / (4 + penalty)), np.float32(penalty)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = penalty * ahead - 2 * ((weight * y * slack) @ x)
        new = ahead - rate * gradient
        ahead, w = new + np.float32(step / (step + 3)) * (new - w), new
    return w


@dataclass
class LanguageModel:
    """Families with their languages, a one-against-rest machine per family and a
    machine for each pair of languages of one family; of every language the mean vector
    and, for each class of lengths, the least likeness to it that a text must have."""

    dim: int
    languages: dict[str, list[str]]
    family_weights: dict[str, np.ndarray]
    pair_weights: dict[tuple[str, str], np.ndarray]
    centres: dict[str, np.ndarray] = field(default_factory=dict)
    floors: dict[str, list[float]] = field(default_factory=dict)
    sharpness: float = 4.0

    def _chance(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.sharpness * margin, -50, 50))))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ties go to the first by name. ``und`` with 0 for
        null and for texts without a letter."""
        return self.examine(text)[:2]

    def examine(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is like those the language was learned
        from. The machines only tell learned languages apart: noise and foreign texts
        land on one side of each too, and often far from it."""
        vector, n = weighed(text, self.dim) if text else (None, 0)
        if vector is None or not self.languages:
            return UNKNOWN, 0.0, False
        lang, score = self._decide(np.append(vector, 1))
        floors = self.floors[lang]
        return lang, score, bool(vector @ self.centres[lang] >= floors[min(length_class(n), len(floors) - 1)])

    def _decide(self, vector: np.ndarray) -> tuple[str, float]:
        chances = {f: self._chance(vector @ w) for f, w in self.family_weights.items()}
        family = max(sorted(self.languages), key=lambda f: chances.get(f, 1.0))
        score = chances.get(family, 1.0) / max(sum(chances.values()), 1e-12) if chances else 1.0
        votes = dict.fromkeys(sorted(self.languages[family]), 0.0)
        for (a, b), w in self.pair_weights.items():
            if a in votes and b in votes:
                for_a = self._chance(vector @ w)
                votes[a] += for_a
                votes[b] += 1 - for_a
        lang = max(votes, key=votes.get)
        rounds = len(votes) - 1
        return lang, score * (votes[lang] / rounds if rounds else 1.0)


def fit(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    rows: int = 3200,
    dim: int = 4096,
    penalty: float = 1e-4,
    steps: int = 200,
    slack: float = SLACK,
    families: Mapping[str, tuple[str, ...]] = FAMILIES,
) -> LanguageModel:
    """A model from the rows with a language and a text. A text counts as like a language
    from ``slack`` times the least likeness that a text learned from has.

    At most ``rows`` texts are taken, or one for each language, as many of each: those
    with the least hashes among the distinct texts of a language, so that copies count
    once whatever their number. Their whole texts become vectors in the tasks, and only
    those vectors reach the driver. The number of distinct languages must be moderate.
    Without rows the model answers ``und`` to everything.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")
    )
    kinds = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    if not kinds:
        return LanguageModel(dim, {}, {}, {})
    each = max(1, rows // len(kinds))
    # More hashes than wanted come below these bounds; only they are ranked.
    shares = F.create_map(*[F.lit(v) for k, n in sorted(kinds.items()) for v in (k, min(1.0, (2 * each + 50) / n))])
    least = known.where(F.col("hash") / 2.0**64 + 0.5 <= shares[F.col("lang")]).select("lang", "hash").distinct()
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("rank") <= each)
    cuts = {r["lang"]: r["cut"] for r in ranked.groupBy("lang").agg(F.max("hash").alias("cut")).collect()}
    cut = F.create_map(*[F.lit(v) for k, c in sorted(cuts.items()) for v in (k, c)])
    chosen = known.where(F.col("hash") <= cut[F.col("lang")]).select("lang", "text").distinct()

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, *weighed(t, dim)) for k, t in zip(batch["lang"], batch["text"])]
            kept = [(k, v.astype(np.float16).tobytes(), n) for k, v, n in found if v is not None]
            yield pd.DataFrame(kept, columns=["lang", "vector", "n"])

    read = chosen.mapInPandas(vectors, "lang string, vector binary, n bigint").collect()
    sample = sorted((r["lang"], bytes(r["vector"]), r["n"]) for r in read)
    if not sample:
        return LanguageModel(dim, {}, {}, {})
    names = np.array([k for k, _, _ in sample])
    classes = np.array([length_class(n) for _, _, n in sample])
    x = np.frombuffer(b"".join(v for _, v, _ in sample), np.float16).reshape(len(sample), dim).astype(np.float32)
    groups = np.array([family_of(k, families) for k in names])
    languages = {g: sorted(set(names[groups == g].tolist())) for g in sorted(set(groups.tolist()))}
    sides = {g: _svm(x, np.where(groups == g, 1.0, -1.0), penalty, steps) for g in languages} if len(languages) > 1 else {}
    pairs = {}
    for members in languages.values():
        for a, b in combinations(members, 2):
            rows_of = (names == a) | (names == b)
            pairs[a, b] = _svm(x[rows_of], np.where(names[rows_of] == a, 1.0, -1.0), penalty, steps)
    centres, floors = {}, {}
    for k in sorted(set(names.tolist())):
        own = x[names == k]
        mean = own.mean(axis=0)
        centres[k] = mean / np.linalg.norm(mean)
        likeness, of = own @ centres[k], classes[names == k]
        # Longer texts are more alike, so a class takes the least of itself and all longer.
        floors[k] = [slack * float(likeness[of >= c].min()) for c in range(of.max() + 1)]
    return LanguageModel(dim, languages, sides, pairs, centres, floors)


def language(model: LanguageModel, text: str = "text") -> Column:
    """Column of ``struct<lang_pred, score>`` for the whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(F.col(text))


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every row. Null texts, and texts without a
    letter, are ``und`` with score 0; repeated rows get equal answers; an empty
    table gives none; other columns are not read."""
    return docs.select(F.col(id_column), language(model, text).alias("found")).select(id_column, "found.*")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.0, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter, whose language is found
    with at least this score and whose text is like those that the language was learned
    from. Null texts go; rows with equal text stay or go together."""

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        found = map(model.examine, texts)
        return pd.Series([lang != UNKNOWN and score >= min_score and like for lang, score, like in found], dtype=bool)

    return docs.where(identified(F.col(text)))
