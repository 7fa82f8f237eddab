"""Training plans: split, fit with early stopping, evaluate, cross-validate, save."""

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.operators import evaluation as V
from lurewatch.operators import training as G
from lurewatch.operators.sampling import assign_folds, balanced_sample, class_distribution, stratified_split
from lurewatch.operators.texts import TextConfig, TextVectorizer
from lurewatch.operators.urls import url_features
from lurewatch.session import materialise
from lurewatch.sources.models import TextDetector, UrlDetector, model_metadata


@dataclass
class TrainingReport:
    """The detector and the evaluation tables of one training run."""

    detector: object
    fit: object
    class_distribution: object
    split_classes: object
    split_sizes: object
    report: object
    confusion: object
    auc: object
    scored: object
    cv_folds: object = None
    importance: object = None
    settings: dict = field(default_factory=dict)


def split_sizes(split, n_features=None):
    """(is_test, n_rows) of a split, with the number of features if given."""
    sizes = split.groupBy("is_test").agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes if n_features is None else sizes.withColumn("n_features", F.lit(n_features))


def _parts(df, ids, test_fraction, seed, reuse_test):
    """``df`` with ``is_test`` and ``part``, written once: which rows fit, which validate and which test.

    By default a slice of the training rows validates and the test rows stay unseen; with ``reuse_test`` the
    test rows do both.
    """
    split = materialise(stratified_split(df, ids=ids, test_fraction=test_fraction, seed=seed), "split")
    if reuse_test:
        return split.withColumn("part", F.when(F.col("is_test"), "test").otherwise("fit"))
    train = split.filter(~F.col("is_test")).drop("is_test")
    inner = stratified_split(train, ids=ids, seed=seed + 1)
    inner = inner.select(*train.columns, F.lit(False).alias("is_test"), F.when(F.col("is_test"), "valid").otherwise("fit").alias("part"))
    return materialise(inner.unionByName(split.filter("is_test").withColumn("part", F.lit("test"))), "parts")


def _parts_of_texts(df, ids, test_fraction, seed, reuse_test):
    """The same for rows with texts, which are written, numbered and joined to what ``_parts`` says of their other columns.
    Ids may repeat, so the number of a row in the table is what tells it apart."""
    rows = materialise(df.withColumn("_key", F.monotonically_increasing_id()), "texts")
    parts = _parts(rows.drop("text"), ids, test_fraction, seed, reuse_test)
    return materialise(rows.select("_key", "text").join(parts, "_key").drop("_key"), "parts")


def _fit_and_valid(rows, reuse_test):
    """The rows with the part each plays in boosting."""
    return rows.withColumn("part", F.when(F.col("part") == ("test" if reuse_test else "valid"), "valid").when(F.col("part") == "fit", "fit"))


def _evaluate(detector_model, test):
    scored = G.probability_of_phishing(detector_model.transform(test), "score")
    scored = scored.withColumn("prediction", (F.col("score") >= K.LABEL_CUT).cast("int"))
    return scored.select("label", "score", "prediction")


def _finish(detector, fit, rows, test, n_features, **extra):
    scored = materialise(_evaluate(detector.model, test), "scored-test")
    return TrainingReport(
        detector=detector,
        fit=fit,
        class_distribution=class_distribution(rows),
        split_classes=rows.groupBy("is_test", "label").agg(F.count(F.lit(1)).alias("n")),
        split_sizes=split_sizes(rows, n_features),
        report=V.classification_report(scored),
        confusion=V.confusion_matrix(scored),
        auc=V.roc_auc(scored),
        scored=scored,
        **extra,
    )


def train_url_detector(
    df, ids, suffixes=None, test_fraction=K.TEST_FRACTION, seed=K.SEED, reuse_test_as_valid=False,
    patience=K.PATIENCE, metric="auc", cv=True, path=None, state=None, **settings,
):
    """Train the url classifier on (ids, url, label) rows.

    Features are computed once and written to the shared folder: every later step reads 18 numbers a row
    and never the urls again. ``settings`` override booster settings; ``reuse_test_as_valid`` lets the test
    rows steer early stopping; with a folder ``state`` an interrupted boosting goes on where it was saved last.
    """
    spark = df.sparkSession
    featured = url_features(df.select(ids, "url", "label"), "url", suffixes).drop("url")
    assembled = UrlDetector.assembler().transform(featured).select(ids, "label", G.FEATURES)
    rows = _parts(assembled, ids, test_fraction, seed, reuse_test_as_valid)
    settings = {**settings, "seed": seed}
    fit = G.fit_booster(_fit_and_valid(rows, reuse_test_as_valid), ids, patience, metric, state, **settings)
    detector = UrlDetector.from_model(fit.model, suffixes=suffixes)
    folds = None
    if cv:
        folded = materialise(assign_folds(rows.drop("is_test", "part"), ids=ids), "folds")
        folds = G.cross_validate(folded, ids, fit.n_trees, **settings)
    if path is not None:
        detector.save(
            spark, path, model_metadata(rows, "gbt_url", "Lexical url features with boosted trees", len(K.URL_FEATURES))
        )
    return _finish(
        detector, fit, rows, rows.filter("is_test"), len(K.URL_FEATURES),
        cv_folds=folds, importance=G.feature_importance(spark, detector.importances()), settings=settings,
    )


def train_text_detector(
    df, ids, config=TextConfig(), test_fraction=K.TEST_FRACTION, seed=K.SEED, reuse_test_as_valid=False,
    patience=K.PATIENCE, metric="auc", path=None, sample_size=None, state=None, **settings,
):
    """Train the text classifier on (ids, text, label) rows. The vocabulary comes from the training rows only.

    ``sample_size`` bounds the labelled rows (a balanced sample); None takes all.
    """
    spark = df.sparkSession
    given = balanced_sample(df.select(ids, "text", "label"), sample_size, ids=ids, seed=seed)
    split = _parts_of_texts(given, ids, test_fraction, seed, reuse_test_as_valid)
    vectorizer = TextVectorizer.fit(split.filter(~F.col("is_test")), "text", config)
    rows = vectorizer.transform(split, "text", G.FEATURES).select(ids, "label", "is_test", "part", G.FEATURES)
    rows = materialise(rows, "text-train")
    settings = {**settings, "seed": seed}
    fit = G.fit_booster(_fit_and_valid(rows, reuse_test_as_valid), ids, patience, metric, state, **settings)
    detector = TextDetector.from_model(vectorizer, fit.model)
    if path is not None:
        metadata = model_metadata(
            rows, "gbt_tfidf", "TF-IDF with boosted trees", config.max_features
        )
        detector.save(spark, path, metadata)
    return _finish(detector, fit, rows, rows.filter("is_test"), len(vectorizer.terms), settings=settings)
