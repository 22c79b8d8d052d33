"""High-impact classifier: label, numeric features and boosted trees."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import impact_text, parse_date, to_number
from ..sources.tables import numeric_only
from ..sources.workspace import through_table
from .boosting import Boosted, Setting, Tree, fit_all
from .metrics import exact_quantile
from .sampling import FOLDS, SEED, stratified_folds
from .text import IMPACT_FEATURES, IMPACT_NGRAM, fit_tfidf
from .topics import K_MAX, K_MIN, K_STEP, RESTARTS, Topics, assign_topics, choose_k

IMPACT_QUANTILE = 0.8
# The grid used when a list is empty, and the full preset.
FALLBACK_GRID = {"depths": [3, 5], "iterations": [200], "steps": [0.1]}
FULL_GRID = {"depths": [3, 5, 7, 9], "iterations": [100, 200, 300], "steps": [0.01, 0.1, 0.2]}
IDENTIFIERS = ["file_id", "document_classification_codes"]
TARGETS = ["citedbycount", "label"]


def label_high_impact(
    df: DataFrame, q: float = IMPACT_QUANTILE, fit_on: DataFrame | None = None
) -> DataFrame:
    """Drops papers without citations and adds ``label``: 1 for citations
    strictly above the quantile. The quantile is that of all the papers, or of
    ``fit_on`` when test papers must not influence it."""
    cited = df.filter(F.col("citedbycount").isNotNull())
    threshold = exact_quantile(df if fit_on is None else fit_on, "citedbycount", q).scalar()
    return cited.withColumn("label", (F.col("citedbycount") > threshold).cast("int"))


def days_from_latest(df: DataFrame) -> DataFrame:
    """Replaces the publication date by the days to the latest one."""
    day = parse_date(F.col("publication_date"))
    latest = df.agg(F.max(day)).scalar()
    return df.withColumn("days_from_latest_date", F.datediff(latest, day)).drop("publication_date")


def with_text(df: DataFrame) -> DataFrame:
    columns = ("citation_title", "sourcetitle", "keywords", "abstracts")
    return df.withColumn("text", impact_text(*[F.col(c) for c in columns]))


def impact_features(df: DataFrame) -> DataFrame:
    """Id, targets and every numeric attribute that may predict them.

    Label afterwards: the latest date is that of all papers, with citations or not.
    """
    if "publication_date" in df.columns:
        df = days_from_latest(df)
    table = df.withColumn("refcount", to_number(F.col("refcount")))
    numbers = numeric_only(table.drop(*IDENTIFIERS, *TARGETS)).columns
    targets = [c for c in TARGETS if c in table.columns]
    return table.select("file_id", *targets, *numbers)


@dataclass
class Prepared:
    features: DataFrame
    text: PipelineModel
    topics: Topics


def prepare(
    papers: DataFrame,
    max_features: int = IMPACT_FEATURES,
    ngram: int = IMPACT_NGRAM,
    k_min: int = K_MIN,
    k_max: int = K_MAX,
    step: int = K_STEP,
    restarts: int = RESTARTS,
    q: float = IMPACT_QUANTILE,
    stop_words: list[str] | None = None,
) -> Prepared:
    """Labelled numeric features with the topic cluster of the best number of
    clusters. Text model and clusters see the papers with citations."""
    labelled = label_high_impact(with_text(days_from_latest(papers)), q)
    numbers = impact_features(labelled).columns[1:]
    # Read by the vocabulary, the vectors and every clustering.
    rows = through_table(labelled.select("file_id", "text", *numbers), "impact-rows")
    text = fit_tfidf(rows, max_features, ngram, stop_words)
    vectors = through_table(text.transform(rows).drop("text"), "impact-vectors")
    topics = choose_k(vectors, k_min, k_max, step, restarts)
    placed = assign_topics(vectors, topics.model).drop("features")
    return Prepared(impact_features(placed), text, topics)


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in (*IDENTIFIERS, *TARGETS, "is_test", "fold")]


def with_missing_flags(df: DataFrame, names: list[str]) -> DataFrame:
    """0/1 columns that tell where a value is missing, for models that need it filled in."""
    numbers = {n: F.col(n).cast("double") for n in names}
    flags = {f"{n}_missing": F.col(n).isNull().cast("double") for n in names}
    return df.withColumns({**numbers, **flags})


@dataclass
class ImpactModel:
    boosted: Boosted
    settings: dict
    scores: DataFrame

    @property
    def names(self) -> list[str]:
        return self.boosted.names

    def predict(self, df: DataFrame) -> DataFrame:
        """``(file_id, label, prediction)``; a missing value goes where the trees learned
        that missing ones go."""
        boosted, names = self.boosted, self.names

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]
                table = np.stack(values, axis=1) if values else np.zeros((batch.num_rows, 0))
                prediction = pa.array((boosted.margins(table) > 0).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], prediction], ["file_id", "label", "prediction"])

        numbers = [F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)]
        rows = df.select("file_id", "label", *numbers)
        kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("file_id", "label")]
        return rows.mapInArrow(predicted, f"{', '.join(kinds)}, prediction int")

    def save(self, where: str) -> None:
        """Write everything that ``load`` needs below a folder all executors reach."""
        self.scores.write.mode("overwrite").parquet(f"{where}/scores")
        row = (json.dumps(asdict(self.boosted)), json.dumps(self.settings))
        self.scores.sparkSession.createDataFrame([row], "model string, settings string").write.mode("overwrite").parquet(f"{where}/model")

    @classmethod
    def load(cls, spark: SparkSession, where: str) -> ImpactModel:
        row = spark.read.parquet(f"{where}/model").first()
        parts = json.loads(row["model"])
        boosted = Boosted(parts["names"], parts["bounds"], [Tree(**t) for t in parts["trees"]])
        return cls(boosted, json.loads(row["settings"]), spark.read.parquet(f"{where}/scores"))

    def importances(self) -> DataFrame:
        """Importance per feature, largest first."""
        rows = list(zip(self.names, self.boosted.importances()))
        table = self.scores.sparkSession.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature")


SCORES = "depth int, iterations int, step double, accuracy double"


def tune_gbt(
    train: DataFrame,
    depths: list[int] | None = None,
    iterations: list[int] | None = None,
    steps: list[float] | None = None,
    folds: int = FOLDS,
    seed: int = SEED,
) -> ImpactModel:
    """Grid search by accuracy over stratified folds, refitted on all rows. An empty list
    stands for its entry of ``FALLBACK_GRID``; ``tune_gbt(train, **FULL_GRID)`` searches
    the larger preset.

    Candidates that differ in iterations share a fit, and all fits, those on all rows
    among them, are boosted together. Of equal candidates the first wins.
    """
    depths = depths or FALLBACK_GRID["depths"]
    iterations = iterations or FALLBACK_GRID["iterations"]
    steps = steps or FALLBACK_GRID["steps"]
    names = feature_names(train)
    ready = through_table(stratified_folds(train, "label", folds=folds, seed=seed), "folds")
    settings = [Setting(d, s, held) for d in depths for s in steps for held in (*range(folds), None)]
    held = frozenset(i for i, s in enumerate(settings) if s.held_out is not None)
    models, scored = fit_all(ready, names, "label", settings, iterations, "fold", held)
    rows = []
    for depth in depths:
        for n in iterations:
            for step in steps:
                parts = [scored.get((Setting(depth, step, held), n)) for held in range(folds)]
                known = [p for p in parts if p is not None]
                rows.append((depth, n, float(step), sum(known) / len(known) if known else None))
    best = max(range(len(rows)), key=lambda i: -1.0 if rows[i][3] is None else rows[i][3])
    chosen = dict(zip(("depth", "iterations", "step", "accuracy"), rows[best]))
    model = models[settings.index(Setting(chosen["depth"], chosen["step"]))]
    model.trees = model.trees[: chosen["iterations"]]
    return ImpactModel(model, chosen, train.sparkSession.createDataFrame(rows, SCORES))


def fit_gbt(train: DataFrame, depth: int, iterations: int, step: float) -> ImpactModel:
    """One classifier with given settings, without a search."""
    models, _ = fit_all(train, feature_names(train), "label", [Setting(depth, step)], [iterations])
    scores = train.sparkSession.createDataFrame([(depth, iterations, float(step), None)], SCORES)
    return ImpactModel(models[0], {"depth": depth, "iterations": iterations, "step": step}, scores)
