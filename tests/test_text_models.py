import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliolake.operators import evaluation, impact, recommend, sampling, text, topics

TEXTS = ["The cat sat, the cat ran", "A dog and a cat_2 sat", "Über straße dog dog", "the the", ""]
STOP = ["the", "and"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)


def brute_terms(value, ngram):
    kept = [w for w in re.findall(r"\b\w\w+\b", value.lower()) if w not in STOP]
    return [" ".join(kept[i : i + n]) for n in range(1, ngram + 1) for i in range(len(kept) - n + 1)]


@pytest.mark.parametrize("ngram", [1, 2, 3])
def test_terms(corpus, ngram):
    rows = text.term_pipeline(ngram, STOP).transform(corpus).collect()
    assert {r.id: r.terms for r in rows} == {i: brute_terms(t, ngram) for i, t in enumerate(TEXTS)}


def test_tfidf_against_brute_force(corpus):
    model = text.fit_tfidf(corpus, max_features=6, ngram=2, stop_words=STOP)
    docs = [Counter(brute_terms(t, 2)) for t in TEXTS]
    tf, df = sum(docs, Counter()), Counter(k for d in docs for k in d)
    vocabulary = sorted(tf, key=lambda k: (-tf[k], k))[:6]
    assert text.vocabulary_of(model) == vocabulary
    got = {(r.id, r.term): r.weight for r in text.weights(model.transform(corpus), model, ["id"]).collect()}
    want = {}
    for i, d in enumerate(docs):
        w = {k: d[k] * (math.log((1 + len(docs)) / (1 + df[k])) + 1) for k in vocabulary if d[k]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, k): x / norm for k, x in w.items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_unseen_words_give_an_empty_vector(corpus, spark):
    model = text.fit_tfidf(corpus, 6, 1, STOP)
    new = spark.createDataFrame([(9, "unseen words"), (10, "dog")], "id int, text string")
    assert [(r.id, r.term) for r in text.weights(model.transform(new), model, ["id"]).collect()] == [(10, "dog")]


def test_only_stop_words(spark):
    df = spark.createDataFrame([("the and",)], "text string")
    with pytest.raises(ValueError):
        text.fit_tfidf(df, 10, 1, STOP)


def test_model_can_be_saved(corpus, tmp_path):
    from pyspark.ml import PipelineModel

    model = text.fit_tfidf(corpus, 6, 2, STOP)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(corpus).orderBy("id").first().features == model.transform(corpus).orderBy("id").first().features


def skewed(spark, rare=400):
    """Texts of a few frequent words, some with rare ones between them."""
    common = ["aa", "bb", "cc", "dd", "the"]
    rows = [[common[(i * i + j) % 5] for j in range(i % 7)] + [f"rare{i % rare}"] + common[: i % 3] for i in range(900)]
    return spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "id int, text string").repartition(5)


@pytest.mark.parametrize("ngram", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 4, 12, 100, 403, 404, 405, 2000])
def test_vocabulary_by_words_is_that_of_all_terms(spark, ngram, size):
    texts = skewed(spark)
    want = Counter(), Counter()
    for r in texts.collect():
        terms = brute_terms(r.text, ngram)
        want[0].update(terms)
        want[1].update(set(terms))
    order = sorted(want[0], key=lambda t: (-want[0][t], t))[:size]
    got = text.vocabulary_of_words(text.words_of(texts.select("text"), STOP), size, ngram).collect()
    assert [tuple(r) for r in got] == [(t, want[0][t], want[1][t]) for t in order]


def test_ngrams_of_rare_words_are_not_counted(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(text, "term_counts", lambda terms, count=text.term_counts: counted.append(terms) or count(terms))
    text.fit_tfidf(skewed(spark), 4, 2, STOP)
    assert not [t for r in counted[0].collect() for t in r.terms if "rare" in t]


def test_vectors_of_the_fit_are_those_of_the_model(spark):
    texts = skewed(spark)
    model, featured = text.fit_transform_tfidf(texts, 12, 2, STOP)
    assert featured.columns == ["id", "features"]
    vectors = {r.id: r.features for r in model.transform(texts).collect()}
    assert {r.id: r.features for r in featured.collect()} == vectors
    assert text.vocabulary_of(model) == text.vocabulary_of(text.fit_tfidf(texts, 12, 2, STOP))


def labelled(spark, sizes):
    rows = [(i, label) for i, label in enumerate(x for x, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "file_id bigint, label int")


@pytest.mark.parametrize("digits", [4, 1])
def test_stratified_split_is_exact(spark, monkeypatch, digits):
    monkeypatch.setattr(sampling, "BUCKET_DIGITS", digits)
    df = labelled(spark, {0: 997, 1: 53, 2: 4})
    split = sampling.stratified_split(df, "label")
    counts = {(r.label, r.is_test): r.n for r in split.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, True): 199, (0, False): 798, (1, True): 10, (1, False): 43, (2, False): 4}
    again = {(r.file_id, r.is_test) for r in sampling.stratified_split(df.repartition(5), "label").collect()}
    assert again == {(r.file_id, r.is_test) for r in split.collect()}


def test_folds_are_even(spark):
    folds = sampling.stratified_folds(labelled(spark, {0: 101, 1: 3}), "label", folds=5)
    counts = Counter((r.label, r.fold) for r in folds.collect())
    assert sum(counts.values()) == 104
    assert sorted(counts[0, f] for f in range(5)) == [20, 20, 20, 20, 21]
    assert all(counts[1, f] <= 1 for f in range(5))


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "label int, prediction int")


def test_report(spark):
    pred = predictions(spark, [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2)
    rows = {r.name: r for r in evaluation.classification_report(pred).collect()}
    assert rows["0"].precision == pytest.approx(3 / 5) and rows["0"].recall == pytest.approx(3 / 4)
    assert rows["1"].f1 == pytest.approx(2 * (2 / 3) * 0.5 / (2 / 3 + 0.5)) and rows["1"].support == 4
    assert rows["accuracy"].f1 == pytest.approx(5 / 8)
    assert rows["macro avg"].recall == rows["weighted avg"].recall == pytest.approx(0.625)


def test_class_never_predicted(spark):
    rows = {r.name: r for r in evaluation.classification_report(predictions(spark, [(0, 0), (1, 0)])).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].f1) == (0.0, 0.0, 0.0)
    matrix = evaluation.confusion(predictions(spark, [(0, 0), (1, 0)])).collect()
    assert [tuple(r) for r in matrix] == [(0, 1, 0), (1, 1, 0)]


def test_label(make_papers):
    p = make_papers(*[{"citedbycount": c} for c in (1, 2, 3, 4, 10, None)])
    labels = {r.citedbycount: r.label for r in impact.label_high_impact(p).collect()}
    assert labels == {1: 0, 2: 0, 3: 0, 4: 0, 10: 1}


def test_features(make_papers):
    p = make_papers(
        {"year": 2018, "publication_date": "01/02/2018", "refcount": "n/a", "citedbycount": 1},
        {"year": None, "publication_date": "11/02/2018", "refcount": "4", "citedbycount": 2},
        {"year": 2018, "publication_date": None, "refcount": "4", "citedbycount": 3},
    )
    rows = {r.file_id: r for r in impact.impact_features(p).collect()}
    assert [rows[i].days_from_latest_date for i in range(3)] == [10, 0, None]
    assert [rows[i].refcount for i in range(3)] == [None, 4.0, 4.0]
    assert "publishername" not in rows[0].asDict()
    flagged = impact.with_missing_flags(impact.impact_features(p), ["year"]).orderBy("file_id").collect()
    assert [r.year_missing for r in flagged] == [0.0, 1.0, 0.0]


def test_latest_date_counts_papers_without_citations(make_papers):
    p = make_papers(
        {"citedbycount": 1, "publication_date": "01/02/2018"}, {"publication_date": "11/02/2018"},
    )
    row = impact.label_high_impact(impact.impact_features(p)).first()
    assert row.file_id == 0 and row.days_from_latest_date == 10


def test_prepare(make_papers):
    words = ["apple pear plum", "iron steel zinc"]
    p = make_papers(
        *[
            {"citedbycount": i, "citation_title": words[i % 2], "abstracts": words[i % 2], "sourcetitle": "J",
             "publication_date": "01/02/2018", "refcount": str(i), "year": 2018}
            for i in range(20)
        ]
    )
    ready = impact.prepare(p, max_features=20, ngram=1, k_min=2, k_max=2, step=1, restarts=2)
    rows = ready.features.collect()
    assert ready.topics.k == 2 and len(rows) == 20
    clusters = {i: {r.topic_cluster for r in rows if r.file_id % 2 == i} for i in (0, 1)}
    assert len(clusters[0]) == len(clusters[1]) == 1 and clusters[0] != clusters[1]
    assert sum(r.label for r in rows) == 4
    assert "topic_cluster" in impact.feature_names(ready.features)
    assert not {"label", "citedbycount", "file_id"} & set(impact.feature_names(ready.features))


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, int(i % 5 == 0), float(i % 5 == 0) + (i % 3) / 10, None if i % 7 == 0 else 1.0) for i in range(200)]
    return spark.createDataFrame(rows, "file_id bigint, label int, a double, b double")


def test_grid_search(separable):
    model = impact.tune_gbt(separable, [2], [3], [0.1, 0.3], folds=3)
    assert model.scores.count() == 2 and model.settings["accuracy"] == pytest.approx(1.0)
    assert model.settings["step"] == 0.1
    assert model.predict(separable).filter("label <> prediction").count() == 0
    best = model.importances().collect()
    assert [r.feature for r in best] == ["a", "b"] and sum(r.importance for r in best) == pytest.approx(1)


def test_staged_search_equals_separate_fits(spark):
    from bibliolake.operators import boosting

    random = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a, b = random.normal(), random.normal()
        rows.append((i, int(a * b + random.normal() / 2 > 0), None if i % 9 == 0 else a, b, float(i % 4)))
    df = spark.createDataFrame(rows, "file_id bigint, label int, a double, b double, c double")
    model = impact.tune_gbt(df, [2, 4], [3, 6], [0.3], folds=2)
    folds = sampling.stratified_folds(df, "label", folds=2).persist()
    for r in model.scores.collect():
        right = []
        for held in range(2):
            alone, _ = boosting.fit_all(folds, model.names, "label", [boosting.Setting(r.depth, r.step, held)], [r.iterations], "fold")
            fitted = impact.ImpactModel(alone[0], {}, model.scores)
            found = fitted.predict(folds.filter(F.col("fold") == held)).collect()
            right.append(np.mean([x.label == x.prediction for x in found]))
        assert r.accuracy == pytest.approx(np.mean(right))
    chosen = model.settings
    again = impact.fit_gbt(df, chosen["depth"], chosen["iterations"], chosen["step"]).boosted.trees
    assert len(again) == len(model.boosted.trees) == chosen["iterations"]
    for a, b in zip(again, model.boosted.trees):
        assert (a.feature, a.cut, a.missing_left) == (b.feature, b.cut, b.missing_left) and np.allclose(a.value, b.value)
    assert chosen["accuracy"] == max(r.accuracy for r in model.scores.collect()) > 0.7


def test_grid_search_runs_few_jobs(spark, monkeypatch):
    """A job for each level of 30 rounds would be 90; the same with rows of several lots."""
    random = np.random.default_rng(4)
    rows = [(i, int(a + random.normal() / 3 > 0), a, random.normal()) for i, a in enumerate(random.normal(size=300).tolist())]
    df = spark.createDataFrame(rows, "file_id bigint, label int, a double, b double")
    found = []
    for least in (1_000, 50):
        monkeypatch.setattr("bibliolake.operators.boosting.LEAST_ROWS", least)
        spark.sparkContext.setJobGroup(f"grid-{least}", "")
        model = impact.tune_gbt(df, [2, 3], [10, 30], [0.1, 0.3], folds=2)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"grid-{least}")) < 60
        found.append([r.accuracy for r in model.scores.collect()])
    spark.sparkContext.setJobGroup("others", "")
    assert found[0] == pytest.approx(found[1], abs=0.02)


def slow_tree(rows, g, h, depth, step):
    """Margins of one tree over rows of bins, split by every cut of every feature."""
    from bibliolake.operators import boosting as b

    def score(at):
        return sum(g[i] for i in at) ** 2 / (sum(h[i] for i in at) + b.PENALTY)

    def grow(at, level):
        best = (b.LEAST_GAIN, None)
        for f in range(len(rows[0])):
            for cut in range(1, b.BINS):
                for missing_left in (False, True):
                    left = [i for i in at if (missing_left if rows[i][f] == 0 else rows[i][f] <= cut)]
                    right = [i for i in at if i not in set(left)]
                    if min(sum(h[i] for i in left), sum(h[i] for i in right)) < b.LEAST_WEIGHT:
                        continue
                    gain = (score(left) + score(right) - score(at)) / 2
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None or level == depth:
            value = -step * sum(g[i] for i in at) / (sum(h[i] for i in at) + b.PENALTY)
            return {i: value for i in at}
        return grow(best[1][0], level + 1) | grow(best[1][1], level + 1)

    return grow(list(range(len(rows))), 0)


@pytest.mark.parametrize("tasks", [1, 5])
def test_trees_equal_a_search_of_all_splits(spark, monkeypatch, tasks):
    from bibliolake.operators import boosting

    monkeypatch.setattr(boosting, "TASK_ROWS", 60 // tasks)
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    random = np.random.default_rng(6)
    x = random.normal(size=(60, 3)).round(1)
    x[::8, 0] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=2) + x[:, 1] ** 2 > 1).astype(int)
    rows = [(int(t), *[None if np.isnan(v) else float(v) for v in r]) for t, r in zip(y, x)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double")
    models, _ = boosting.fit_all(df, ["a", "b", "c"], "label", [boosting.Setting(3, 0.3), boosting.Setting(2, 0.5)], [3])
    for model, (depth, step) in zip(models, [(3, 0.3), (2, 0.5)]):
        bins = boosting._binned(x, [np.array(b) for b in model.bounds])
        margin = np.zeros(60)
        for _ in range(3):
            p = 1 / (1 + np.exp(-margin))
            leaf = slow_tree(bins.tolist(), p - y, p * (1 - p), depth, step)
            margin = margin + np.array([leaf[i] for i in range(60)])
        assert np.allclose(model.margins(x), margin)


def test_boosting_without_features_or_with_one_class(spark):
    df = spark.createDataFrame([(i, 1, 1.0) for i in range(20)], "file_id bigint, label int, a double")
    model = impact.fit_gbt(df, 3, 4, 0.3)
    assert {r.prediction for r in model.predict(df).collect()} == {1}
    assert [r.importance for r in model.importances().collect()] == [0.0]
    empty = impact.fit_gbt(df.drop("a").withColumn("label", F.lit(0)), 3, 2, 0.3)
    assert {r.prediction for r in empty.predict(df).collect()} == {0}


def test_saved_impact_model_predicts_the_same(spark, separable, tmp_path):
    model = impact.fit_gbt(separable, 2, 3, 0.1)
    model.save(str(tmp_path / "model"))
    loaded = impact.ImpactModel.load(spark.newSession(), str(tmp_path / "model"))
    assert loaded.settings == model.settings and loaded.names == model.names
    assert sorted(map(tuple, loaded.predict(separable).collect())) == sorted(map(tuple, model.predict(separable).collect()))
    assert loaded.importances().collect() == model.importances().collect()


def test_empty_lists_fall_back(separable, monkeypatch):
    monkeypatch.setattr(impact, "FALLBACK_GRID", {"depths": [2], "iterations": [2], "steps": [0.1]})
    assert impact.tune_gbt(separable, [], None, [], folds=2).scores.count() == 1


@pytest.fixture(scope="module")
def vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.dense([float(i % 3) * 10, (i % 5) / 10])) for i in range(90)]
    return spark.createDataFrame(rows, ["file_id", "features"])


def test_best_k(vectors):
    chosen = topics.choose_k(vectors, 2, 4, 1, restarts=2)
    assert chosen.k == 3 and chosen.scores.count() == 3
    assert topics.assign_topics(vectors, chosen.model).select("topic_cluster").distinct().count() == 3
    assert topics.assign_topics(vectors, None).select("topic_cluster").distinct().first()[0] == -1


def test_restarts_are_reproducible(vectors):
    centers = [topics.fit_kmeans(vectors, 3, restarts=2).clusterCenters() for _ in range(2)]
    assert [c.tolist() for c in centers[0]] == [c.tolist() for c in centers[1]]


def lloyd(points, centres, max_iter=300):
    """Lloyd's steps one row at a time."""
    for _ in range(max_iter):
        near = [min(range(len(centres)), key=lambda c: ((p - centres[c]) ** 2).sum()) for p in points]
        new = [np.mean([p for p, n in zip(points, near) if n == c], axis=0) if c in near else centres[c] for c in range(len(centres))]
        moved = max(((a - b) ** 2).sum() for a, b in zip(new, centres))
        centres = new
        if moved <= topics.TOLERANCE**2:
            break
    return np.array(centres), sum(min(((p - c) ** 2).sum() for c in centres) for p in points)


@pytest.fixture(scope="module")
def cloud(spark):
    """Sparse and dense vectors, some of them equal, one without an entry."""
    from pyspark.ml.linalg import Vectors

    random = np.random.default_rng(4)
    points = np.concatenate([random.normal(c, 1.0, (60, 3)) for c in (0, 4, 9)]).round(2)
    points[::7, 1] = 0
    points = np.concatenate((points, points[:9], np.zeros((1, 3))))
    rows = [(Vectors.dense(p) if i % 3 else Vectors.sparse(3, [(j, v) for j, v in enumerate(p) if v]),) for i, p in enumerate(points)]
    return points, spark.createDataFrame(rows, ["features"]).repartition(5)


def test_all_starts_together_equal_separate_fits(cloud):
    points, df = cloud
    random = np.random.default_rng(1)
    first = {(k, s): points[random.choice(len(points), k, replace=False)] for k in (2, 3, 5) for s in range(3)}
    together = topics.fit_all(df, [2, 3, 5], restarts=3, first=first)
    assert [(f.k, f.start) for f in together] == sorted(first)
    for fit in together:
        centres, cost = lloyd(points, list(first[fit.k, fit.start]))
        assert np.allclose(fit.centres, centres) and fit.cost == pytest.approx(cost)
        assert fit.sizes.sum() == len(points)
        alone = topics.fit_all(df, [fit.k], restarts=fit.start + 1, first=first)[-1]
        assert np.allclose(alone.centres, fit.centres) and alone.scans == fit.scans


def test_scans_do_not_grow_with_the_models(cloud, monkeypatch):
    _, df = cloud
    scans = []
    scan = topics._scan
    monkeypatch.setattr(topics, "_scan", lambda *a: scans.append(len(a[1])) or scan(*a))
    fits = topics.fit_all(df, [2, 3, 4], restarts=4)
    assert len(scans) == max(f.scans for f in fits) + 1 and scans[0] == scans[-1] == 12


def test_sums_of_many_tasks_are_added_in_two_steps(cloud, monkeypatch):
    _, df = cloud
    plain = topics.fit_all(df, [3], restarts=2)
    monkeypatch.setattr("bibliolake.operators.scans.FAN_IN", 2)
    assert all(np.allclose(a.centres, b.centres) for a, b in zip(plain, topics.fit_all(df, [3], restarts=2)))


def test_starts_spread_over_far_groups(vectors):
    assert all(f.cost == pytest.approx(topics.best_fit([f]).cost) for f in topics.fit_all(vectors, [3], restarts=3))
    assert topics.fit_all(vectors.limit(0), [3]) == []
    fit = topics.fit_all(vectors.limit(2), [4], restarts=1)[0]  # fewer rows than clusters
    assert fit.sizes.sum() == 2 and fit.cost == pytest.approx(0)


def slow_silhouette(points, labels):
    values = []
    for i, p in enumerate(points):
        far = {c: [np.sqrt(((p - q) ** 2).sum()) for j, q in enumerate(points) if labels[j] == c and j != i] for c in set(labels)}
        a, b = far[labels[i]], min(np.mean(d) for c, d in far.items() if c != labels[i])
        a = np.mean(a) if a else None
        values.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(values)


def with_labels(spark, points, labels):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense(p), int(c)) for p, c in zip(points, labels)]
    return spark.createDataFrame(rows, ["features", "topic_cluster"]).repartition(4)


@pytest.mark.parametrize("clusters", [2, 4])
def test_silhouette_equals_all_pairs(spark, cloud, clusters):
    points, df = cloud
    labels = np.random.default_rng(2).integers(0, clusters, len(points))
    labels[-1] = clusters  # a cluster of one row
    got, error = topics.silhouette(with_labels(spark, points, labels))
    assert got == pytest.approx(slow_silhouette(points, labels.tolist())) and error == 0


def test_silhouette_of_a_sample_is_within_its_error(spark):
    random = np.random.default_rng(8)
    labels = random.integers(0, 3, 900)
    points = random.normal(labels[:, None] * 2.0, 1.0, (900, 4))
    frame = with_labels(spark, points, labels)
    exact, none = topics.silhouette(frame, sample=1000)
    assert none == 0
    for seed in (1, 2, 3):
        got, error = topics.silhouette(frame, sample=48, seed=seed)
        assert 0 < error < 0.05 and abs(got - exact) < 4 * error


@pytest.mark.parametrize("size", [3, 40])
def test_silhouette_measures_all_pairs(spark, monkeypatch, size):
    """Also of clusters with thousands of rows, with copies, rows without an entry and a
    cluster of copies alone, for rows in several groups and blocks."""
    from bibliolake.operators import pairs

    random = np.random.default_rng(9)
    labels = np.array([random.integers(0, k, 2_400) for k in (2, 5)])
    points = random.random((2_400, size)) * (random.random((2_400, size)) < 8 / size) + labels[0][:, None] * 0.2
    points[100:300], points[500:510] = points[300:500], 0
    points[600:640], labels[1][600:640] = points[600] + 0.5, 9
    points[:, -5:] *= random.random((2_400, min(size, 5))) < 0.02
    far = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in points])
    want = []
    for own in labels:
        sums, sizes = np.stack([far[:, own == c].sum(axis=1) for c in np.unique(own)], axis=1), np.unique(own, return_counts=True)[1]
        want.append(np.mean(pairs._values(sums, np.searchsorted(np.unique(own), own), sizes)))
    frame = with_labels(spark, points, range(len(points))).collect()
    rows = [(r.features, *[int(x) for x in labels[:, r.topic_cluster]]) for r in frame]
    df = spark.createDataFrame(rows, ["features", "topic_cluster", "other"]).repartition(3)
    got, error = topics.silhouette(df)
    assert got == pytest.approx(want[0], abs=1e-9) and error == 0
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 100)
    assert pairs.silhouettes(df, ["other", "topic_cluster"]) == pytest.approx(want[::-1], abs=1e-9)
    assert pairs.silhouettes(df.withColumn("one", F.lit(1)), ["one", "other"]) == [None, pytest.approx(want[1], abs=1e-9)]


def test_best_k_is_chosen_by_all_pairs(spark, vectors):
    many = vectors.crossJoin(spark.range(20)).select("features")  # more than 512 rows of a cluster
    scores = {r.k: r for r in topics.choose_k(many, 2, 3, 1, restarts=2).scores.collect()}
    points = np.array([r.features.toArray() for r in many.collect()])
    fits = topics.fit_all(many.persist(), [2, 3], restarts=2)
    for k, row in scores.items():
        fit = topics.best_fit([f for f in fits if f.k == k])
        labels = topics._squared(points, (points**2).sum(axis=1), fit.centres).argmin(axis=1)
        far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        sums = np.stack([far[:, labels == c].sum(axis=1) for c in range(k)], axis=1)
        sizes, me = np.bincount(labels), np.arange(len(points))
        a = sums[me, labels] / (sizes[labels] - 1)
        others = sums / sizes
        others[me, labels] = np.inf
        b = others.min(axis=1)
        assert row.silhouette == pytest.approx(np.mean((b - a) / np.maximum(a, b))) and row.error == 0


def test_silhouette_needs_two_clusters(spark, cloud):
    points, df = cloud
    assert topics.silhouette(with_labels(spark, points, [1] * len(points))) is None


def test_topics_are_numbered_by_their_centres(vectors):
    models = [topics.fit_kmeans(vectors, 3, restarts=1, seed=s) for s in (1, 2, 3)]
    found = [{(r.file_id, r.topic_cluster) for r in topics.assign_topics(vectors, model).collect()} for model in models]
    assert found[0] == found[1] == found[2]


@pytest.fixture(scope="module")
def journals(make_papers):
    words = {"J1": "apple pear plum fruit", "J2": "iron steel zinc metal", "J3": "rain snow wind storm"}
    rows = []
    for i in range(60):
        name = f"J{i % 3 + 1}"
        parts = words[name].split()
        rows.append({"citation_title": parts[i % 4], "abstracts": words[name], "sourcetitle": name, "keywords": [parts[0]]})
    return make_papers(*rows, {"citation_title": " ", "sourcetitle": "J1"}, {"citation_title": "x", "sourcetitle": " "})


def manuscripts(spark):
    rows = [(1, "Steel", "zinc", ""), (2, " ", None, ""), (3, None, "snow storm", "wind"), (4, "fruit", "", None)]
    return spark.createDataFrame(rows, "id int, title string, abstract string, keywords string")


@pytest.mark.parametrize("clusters", [None, 2])
def test_recommendations(spark, journals, clusters):
    rows = recommend.training_set(journals)
    assert rows.count() == 60
    model = recommend.train(rows, max_features=50, clusters=clusters, max_iter=50, restarts=1)
    best = recommend.recommend(model, manuscripts(spark), "id", k=3).orderBy("id", "rank").collect()
    assert [(r.id, r.journal) for r in best if r.rank == 1] == [(1, "J2"), (3, "J3"), (4, "J1")]
    for i in (1, 3, 4):
        p = [r.probability for r in best if r.id == i]
        assert p == sorted(p, reverse=True) and sum(p) <= 1.001


def test_cluster_of_one_journal_uses_the_overall_model(spark, journals):
    rows = recommend.training_set(journals)
    model = recommend.train(rows, max_features=50, clusters=3, max_iter=50, restarts=3)
    assert model.per_cluster == {} and not model.routed
    best = recommend.recommend(model, manuscripts(spark), "id", k=1).collect()
    assert {r.id: r.journal for r in best} == {1: "J2", 3: "J3", 4: "J1"}


@pytest.mark.parametrize("clusters", [None, 2])
def test_saved_journal_model_recommends_the_same(spark, journals, tmp_path, clusters):
    model = recommend.train(recommend.training_set(journals), max_features=50, clusters=clusters, max_iter=50, restarts=1)
    model.save(str(tmp_path / "model"))
    loaded = recommend.JournalModel.load(spark.newSession(), str(tmp_path / "model"))
    assert loaded.routed == model.routed
    both = [sorted(map(tuple, recommend.recommend(x, manuscripts(spark), "id", k=3).collect())) for x in (model, loaded)]
    assert both[0] == both[1] and both[0]


@pytest.mark.parametrize("tasks", [1, 3])
def test_regressions_together_equal_the_estimator(spark, monkeypatch, tasks):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from bibliolake.operators import regression, scans

    monkeypatch.setattr(regression, "GRADIENT", 1e-7)
    monkeypatch.setattr(regression, "TASK_ROWS", 90 // tasks)
    monkeypatch.setattr(scans, "FAN_IN", 2)
    random = np.random.default_rng(5)
    rows = []
    for i in range(90):
        x = random.normal(size=5) * (random.random(5) < 0.6)
        label = int(np.argmax(x[:3] + random.normal(size=3) / 2))
        rows.append((float(label), int(i % 2), Vectors.sparse(5, [(j, v) for j, v in enumerate(x) if v])))
    df = spark.createDataFrame(rows, ["label", "cluster", "features"]).repartition(4)
    labels, papers = {-1: [0, 1, 2], 0: [0, 1, 2], 1: [0, 1, 2]}, {-1: 90, 0: 45, 1: 45}
    weights = regression.fit_all(df, 5, labels, papers, 500)
    for m, w in weights.items():
        part = df if m < 0 else df.filter(F.col("cluster") == m)
        fit = LogisticRegression(family="multinomial", regParam=1 / papers[m], standardization=False, tol=1e-12, maxIter=1000).fit(part)
        assert np.allclose(fit.coefficientMatrix.toArray(), w[:, :5], atol=1e-3)
        p = regression.as_model(w, df).transform(part).select("probability").collect()
        q = fit.transform(part).select("probability").collect()
        assert np.allclose([r[0].toArray() for r in p], [r[0].toArray() for r in q], atol=1e-3)


def test_too_many_coefficients_are_refused(journals, monkeypatch):
    monkeypatch.setattr(recommend, "MAX_COEFFICIENTS", 20)
    with pytest.raises(ValueError, match="select_journals"):
        recommend.train(recommend.training_set(journals), max_features=10)


def test_journal_selection(make_papers):
    p = make_papers(*[{"sourcetitle": j} for j in ("b", "a", "a", "c", "c", None)])
    names = lambda df: sorted(r.sourcetitle for r in df.collect())
    assert names(recommend.select_journals(p)) == ["a", "a", "b", "c", "c"]
    assert names(recommend.select_journals(p, "top", n=1)) == ["a", "a"]
    assert names(recommend.select_journals(p, "min", m=2)) == ["a", "a", "c", "c"]
    assert names(recommend.select_journals(p, "min", m=9)) == ["a", "a", "b", "c", "c"]
    summary = recommend.training_summary(p, "top", n=2).first()
    assert tuple(summary) == (4, 2, "Learned from the 2 journals with most papers.")
    assert recommend.training_summary(p, "min", m=2).first().coverage == "Learned from the journals with 2 papers or more, 2 in all."


def test_dictionary_of_many_journals(spark):
    # Ranges are cut by bytes, as names compare; labels are dense and keep that order.
    n = 200_000
    names = spark.range(n).select(F.concat(F.lit("é"), F.reverse(F.col("id").cast("string"))).alias("sourcetitle"))
    rows = names.unionByName(names.limit(50)).unionByName(spark.createDataFrame([(None,)], "sourcetitle string"))
    dictionary = recommend.journal_dictionary(rows.repartition(7)).persist()
    totals = dictionary.agg(F.count("*"), F.count_distinct("label"), F.min("label"), F.max("label")).first()
    assert tuple(totals) == (n, n, 0, n - 1)
    got = {r.sourcetitle: r.label for r in dictionary.filter("label % 5000 = 0 or label < 3").collect()}
    want = sorted("é" + str(i)[::-1] for i in range(n))
    assert all(want[i] == name for name, i in got.items())
    assert dictionary.rdd.getNumPartitions() >= 1 and "label" in recommend.encode_journals(rows, dictionary).columns
    back = recommend.decode_journals(recommend.encode_journals(rows, dictionary), dictionary)
    assert back.filter(~F.col("journal").eqNullSafe(F.col("sourcetitle"))).isEmpty() and back.count() == n + 51
    assert recommend.journal_dictionary(rows.limit(0)).count() == 0


def test_softmax(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, 1000.0])], "id int, score array<double>")
    p = recommend.softmax(df, ["id"]).first().probability
    assert sum(p) == pytest.approx(1) and p[2] == pytest.approx(1)
