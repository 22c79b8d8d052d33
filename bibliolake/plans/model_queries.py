"""Labels, splits, clusters, classifiers and their evaluation.

Models are fitted on the whole texts and tables with the library's defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, impact, recommend, sampling, topics
from ..operators.text import IMPACT_FEATURES, IMPACT_NGRAM, fit_tfidf
from ..sources.workspace import through_table
from .registry import over_papers, query
from .tables import table


@over_papers(
    "lbl_01_high_impact",
    "SELECT file_id, CASE WHEN citedbycount > (SELECT quantile_cont(citedbycount, 0.8) FROM papers) THEN 1 ELSE 0 END AS label "
    "FROM papers WHERE citedbycount IS NOT NULL",
)
def high_impact(p):
    return impact.label_high_impact(p).select("file_id", "label")


ENCODED = "(SELECT DISTINCT sourcetitle, dense_rank() OVER (ORDER BY sourcetitle) - 1 AS label FROM papers)"


@over_papers(
    "lbl_02_journal_labels",
    f"SELECT p.file_id, e.label FROM papers p JOIN {ENCODED} e ON p.sourcetitle = e.sourcetitle",
)
def journal_labels(p):
    encoded = recommend.encode_journals(p.select("file_id", "sourcetitle"))
    return encoded.select("file_id", F.col("label").cast("bigint").alias("label"))


@over_papers("lbl_03_labels_decoded", "SELECT file_id, sourcetitle AS journal FROM papers")
def labels_decoded(p):
    rows = p.select("file_id", "sourcetitle")
    dictionary = through_table(recommend.journal_dictionary(rows), "journals")
    return recommend.decode_journals(recommend.encode_journals(rows, dictionary), dictionary).select("file_id", "journal")


@over_papers(
    "sel_01_top_journals",
    "SELECT file_id, sourcetitle FROM papers WHERE sourcetitle IN "
    "(SELECT sourcetitle FROM papers GROUP BY 1 ORDER BY count(*) DESC, sourcetitle LIMIT 7)",
)
def papers_of_top_journals(p):
    return recommend.select_journals(p, "top", n=7).select("file_id", "sourcetitle")


@over_papers(
    "sel_01_journals_with_enough_papers",
    "SELECT file_id, publishername FROM papers WHERE publishername IN "
    "(SELECT publishername FROM papers GROUP BY 1 HAVING count(*) >= 8)",
)
def papers_of_large_journals(p):
    renamed = p.select("file_id", F.col("publishername").alias("sourcetitle"))
    chosen = recommend.select_journals(renamed, "min", m=8)
    return chosen.select("file_id", F.col("sourcetitle").alias("publishername"))


@over_papers("sel_01_none_qualifies", "SELECT file_id FROM papers")
def no_journal_qualifies(p):
    return recommend.select_journals(p, "min", m=1_000_000_000).select("file_id")


@over_papers(
    "fea_01_numeric_features",
    "SELECT file_id, year, refs AS refcount, authors_count AS allauthors_count, authors_count, funding_count, citedbycount, "
    "CAST((SELECT max(pub_day) FROM counted) - pub_day AS INTEGER) AS days_from_latest_date FROM counted",
)
def numeric_features(p):
    return impact.impact_features(p)


@over_papers("fea_02_missing_flags", "SELECT file_id, CAST(year IS NULL AS DOUBLE) AS year_missing, CAST(refs IS NULL AS DOUBLE) AS refcount_missing FROM counted")
def missing_flags(p):
    flagged = impact.with_missing_flags(impact.impact_features(p), ["year", "refcount"])
    return flagged.select("file_id", "year_missing", "refcount_missing")


RANKED = (
    "ranked AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER "
    "(PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS r FROM labels)"
)


@query(
    "spl_01_stratified_split",
    f"WITH {RANKED} SELECT doc_id, quality, r <= floor(n * 0.2::DOUBLE) AS is_test FROM ranked",
)
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.stratified_split(rows, "quality", "doc_id")


@query(
    "spl_01_stratified_folds",
    f"WITH {RANKED} SELECT doc_id, CAST((r > floor(n * 0.2::DOUBLE)) AS INTEGER) + CAST((r > floor(n * 0.4::DOUBLE)) AS INTEGER) + "
    "CAST((r > floor(n * 0.6::DOUBLE)) AS INTEGER) + CAST((r > floor(n * 0.8::DOUBLE)) AS INTEGER) AS fold FROM ranked",
)
def stratified_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.stratified_folds(rows, "quality", "doc_id").select("doc_id", "fold")


# A rule stands in for a model: long texts are predicted to be good ones.
RULE = "CASE WHEN n_chars >= 1200 THEN 1 ELSE 0 END"
JUDGED = f"""WITH judged AS (SELECT l.quality AS label, {RULE} AS prediction FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
classes AS (SELECT label AS c FROM judged UNION SELECT prediction FROM judged),
tallies AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted,
  count(*) FILTER (label = c AND prediction = c) AS hit FROM judged, classes GROUP BY c),
rates AS (SELECT *, coalesce(hit / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall FROM tallies),
scored AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rates)"""


def judged(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rule = F.when(F.col("n_chars") >= 1200, 1).otherwise(0)
    lengths = table(spark, sf_dir, "documents").select("doc_id", rule.alias("prediction"))
    return labels.join(lengths, "doc_id")


def _rounded(report):
    return report.select("name", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "evl_01_classification_report",
    JUDGED
    + """ SELECT name, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (
  SELECT CAST(c AS VARCHAR) AS name, support, precision, recall, f1 FROM scored
  UNION ALL SELECT 'accuracy', sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support) FROM scored
  UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM scored
  UNION ALL SELECT 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support) FROM scored)""",
)
def classification_report(spark, sf_dir):
    return _rounded(evaluation.classification_report(judged(spark, sf_dir)))


@query(
    "evl_02_confusion_matrix",
    JUDGED
    + " SELECT label, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1 "
    "FROM judged GROUP BY label",
)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(judged(spark, sf_dir))


@over_papers(
    "mod_09_training_summary",
    """SELECT 'all' AS mode, sum(n)::BIGINT AS papers, count(*) AS journals, 'Learned from all ' || count(*) || ' journals.' AS coverage FROM per
UNION ALL SELECT 'top', sum(n)::BIGINT, count(*), 'Learned from the 7 journals with most papers.'
  FROM (SELECT * FROM per ORDER BY n DESC, sourcetitle LIMIT 7)
UNION ALL SELECT 'min', sum(n)::BIGINT, count(*), 'Learned from the journals with 2 papers or more, ' || count(*) || ' in all.' FROM per WHERE n >= 2""",
    ctes="per AS (SELECT sourcetitle, count(*) AS n FROM papers WHERE sourcetitle IS NOT NULL GROUP BY 1)",
)
def training_summary(p):
    modes = {"all": {}, "top": {"n": 7}, "min": {"m": 2}}
    parts = [recommend.training_summary(p, mode, **more).withColumn("mode", F.lit(mode)) for mode, more in modes.items()]
    return reduce(DataFrame.unionByName, parts)


# Models of whole texts and of all numbers have no answer in SQL; their parts are tested
# against brute force in tests/test_text_models.py.
def _vectors(p):
    """TF-IDF vectors of the whole texts with the default features and n-grams."""
    rows = through_table(impact.with_text(p).select("file_id", "sourcetitle", "text"), "texts")
    model = fit_tfidf(rows, IMPACT_FEATURES, IMPACT_NGRAM)
    return through_table(model.transform(rows).drop("text"), "vectors")


def _topics(p):
    """With the default number of starts and of iterations, and the fewest clusters of the
    default range."""
    rows = _vectors(p)
    return topics.assign_topics(rows, topics.fit_kmeans(rows, topics.K_MIN))


@over_papers("clu_01_kmeans_with_restarts")
def kmeans(p):
    return _topics(p).groupBy("topic_cluster").agg(F.count("*").alias("papers"))


@over_papers("clu_02_best_k")
def best_k(p):
    """Of the default range, by the Euclidean silhouette."""
    return topics.choose_k(_vectors(p)).scores.orderBy(F.desc_nulls_last("silhouette"), "k").limit(1).select("k", "silhouette")


@over_papers("clu_03_silhouette_per_k")
def silhouette_per_k(p):
    return topics.choose_k(_vectors(p)).scores


@over_papers("clu_04_topic_of_each_paper")
def topic_of_each_paper(p):
    return _topics(p).select("file_id", "topic_cluster")


# All pairs of papers, in the query as well.
SILHOUETTE = """WITH points AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) AS INTEGER) AS c,
  ln(1 + n_chars)::DOUBLE AS x, ln(1 + len(text) - len(replace(text, chr(10), '')))::DOUBLE AS y FROM documents),
apart AS (SELECT a.doc_id, a.c, b.c AS other, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS far
  FROM points a JOIN points b ON a.doc_id <> b.doc_id GROUP BY ALL),
sides AS (SELECT doc_id, c, max(far) FILTER (other = c) AS a, min(far) FILTER (other <> c) AS b FROM apart GROUP BY doc_id, c)
SELECT c AS topic_cluster, count(*) AS papers, (SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6)
  FROM sides) AS silhouette FROM sides GROUP BY c"""


@query("clu_05_silhouette_of_languages", SILHOUETTE)
def silhouette_of_languages(spark, sf_dir):
    """How well the languages part the papers by length and lines."""
    docs = table(spark, sf_dir, "documents")
    langs = F.sort_array(docs.agg(F.collect_set("lang")).scalar())
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    point = F.array(F.log1p(F.col("n_chars").cast("double")), F.log1p(lines.cast("double")))
    rows = docs.select(F.array_position(langs, F.col("lang")).cast("int").alias("topic_cluster"), array_to_vector(point).alias("features"))
    rows = through_table(rows, "points")
    value, _ = topics.silhouette(rows)
    return rows.groupBy("topic_cluster").agg(F.count("*").alias("papers")).withColumn("silhouette", F.round(F.lit(value), 6))


@over_papers("clu_05_silhouette_of_topics")
def silhouette_of_topics(p):
    """Value and standard error for the topics of whole texts."""
    found = topics.silhouette(_topics(p))
    return p.sparkSession.createDataFrame([found or (None, None)], "silhouette double, error double")


@over_papers("agg_32_cluster_coverage")
def cluster_coverage(p):
    return topics.cluster_coverage(_topics(p))


#: The user's choice of depth, rounds and step.
TREES = {"depth": 3, "iterations": 100, "step": 0.1}


def _parts(features):
    """Training and test rows of the high-impact papers and the others."""
    rows = through_table(sampling.stratified_split(through_table(features, "features"), "label"), "impact")
    return rows.filter("not is_test").drop("is_test"), rows.filter("is_test").drop("is_test")


def _numbers(p):
    return _parts(impact.label_high_impact(impact.impact_features(p)))


@over_papers("mod_01_boosted_trees")
def boosted_trees(p):
    train, test = _numbers(p)
    return _rounded(evaluation.classification_report(impact.fit_gbt(train, **TREES).predict(test)))


@over_papers("mod_02_grid_search")
def grid_search(p):
    """All 36 candidates of the larger preset over five folds."""
    train, _ = _numbers(p)
    return impact.tune_gbt(train, **impact.FULL_GRID).scores


@over_papers("mod_03_default_grid")
def default_grid(p):
    """The grid that stands for empty lists."""
    train, _ = _numbers(p)
    return impact.tune_gbt(train, [], [], []).scores


def _importances(p):
    train, _ = _numbers(p)
    return impact.fit_gbt(train, **TREES).importances()


over_papers("mod_04_feature_importance")(_importances)
over_papers("top_16_features")(lambda p: _importances(p).limit(12))


@over_papers(
    "fea_01_features_with_topic",
    "SELECT c.file_id, citedbycount, CASE WHEN citedbycount > (SELECT quantile_cont(citedbycount, 0.8) FROM papers) THEN 1 ELSE 0 END AS label, "
    "year, refs AS refcount, authors_count AS allauthors_count, authors_count, funding_count, "
    "CAST((SELECT max(pub_day) FROM counted) - pub_day AS INTEGER) AS days_from_latest_date, true AS placed FROM counted c WHERE citedbycount IS NOT NULL",
)
def features_with_topic(p):
    """Text features, starts and numbers of clusters as by default."""
    prepared = impact.prepare(p)
    placed = F.col("topic_cluster").between(0, prepared.topics.k - 1)
    return prepared.features.withColumn("placed", placed).drop("topic_cluster")


@over_papers("mod_01_boosted_trees_with_topic")
def boosted_trees_with_topic(p):
    train, test = _parts(impact.prepare(p).features)
    return _rounded(evaluation.classification_report(impact.fit_gbt(train, **TREES).predict(test)))


#: The recommender's usual number of topic clusters.
CLUSTERS = 8


def _trained(p, clusters=None):
    """On title, abstract and keywords of all papers, with the default features, n-grams
    and iterations."""
    return recommend.train(through_table(recommend.training_set(p), "training"), clusters=clusters)


def _recommended(p, model, k=recommend.CHOICES):
    manuscripts = p.select("file_id", F.col("citation_title").alias("title"), F.col("abstracts").alias("abstract"), F.array_join("keywords", " ").alias("keywords"))
    return recommend.recommend(model, manuscripts, "file_id", k)


@over_papers("mod_05_journal_classifier")
def journal_classifier(p):
    return _recommended(p, _trained(p), k=1)


@over_papers("mod_06_classifier_per_topic")
def classifier_per_topic(p):
    """Papers and journals that the model of each topic learned from."""
    model = _trained(p, clusters=CLUSTERS)
    rows = [(c, own.papers, len(own.journals)) for c, own in model.per_cluster.items()]
    return p.sparkSession.createDataFrame(rows, "topic_cluster int, papers bigint, journals int")


@over_papers("mod_07_recommendations_by_topic")
def recommendations_by_topic(p):
    return _recommended(p, _trained(p, clusters=CLUSTERS))


@over_papers("mod_08_recommendations")
def recommendations(p):
    return _recommended(p, _trained(p))


# Shares of three list lengths stand for probabilities, so the ranking is checked.
SHARES = """shares AS (SELECT file_id, unnest(['authors', 'funders', 'keywords']) AS journal, unnest([
  exp(a - greatest(a, f, k)), exp(f - greatest(a, f, k)), exp(k - greatest(a, f, k))]) / (exp(a - greatest(a, f, k)) +
  exp(f - greatest(a, f, k)) + exp(k - greatest(a, f, k))) AS p FROM (SELECT file_id, authors_count / 8.0::DOUBLE AS a,
  funding_count / 8.0::DOUBLE AS f, len(keywords) / 8.0::DOUBLE AS k FROM counted)),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY p DESC, journal) AS INTEGER) AS rank FROM shares)"""


def _shares(p):
    counts = [F.col("authors_count"), F.col("funding_count"), F.size("keywords")]
    scores = p.select("file_id", F.array(*[c / 8.0 for c in counts]).alias("score"))
    return recommend.softmax(scores, ["file_id"]).withColumnRenamed("probability", "p")


@over_papers(
    "top_14_most_probable_labels",
    "SELECT file_id, rank, journal, round_even(p, 4) AS probability FROM placed WHERE rank <= 2",
    ctes=SHARES,
)
def most_probable_labels(p):
    return recommend.most_probable(_shares(p), ["file_id"], ["authors", "funders", "keywords"], 2)


@over_papers("win_04_rank_of_labels", "SELECT file_id, rank, journal FROM placed", ctes=SHARES)
def rank_of_labels(p):
    best = recommend.most_probable(_shares(p), ["file_id"], ["authors", "funders", "keywords"], 3)
    return best.drop("probability")


@over_papers(
    "agg_32_coverage_of_given_clusters",
    "SELECT topic_cluster, count(*) AS papers, count(DISTINCT sourcetitle) AS journals FROM (SELECT CAST(file_id % 7 + "
    "7 * (len(keywords) // 20) AS INTEGER) AS topic_cluster, sourcetitle FROM papers) GROUP BY 1 HAVING count(DISTINCT sourcetitle) >= 2",
)
def coverage_of_given_clusters(p):
    cluster = F.expr("int(file_id % 7 + 7 * (size(keywords) div 20))")
    return topics.cluster_coverage(p.select("sourcetitle", cluster.alias("topic_cluster")))
