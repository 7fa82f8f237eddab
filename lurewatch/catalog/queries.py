"""Registered queries: one per operator, each over the whole of its tables."""

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.catalog import inputs as I
from lurewatch.functions import decisions as D
from lurewatch.functions import experts as E
from lurewatch.functions import text as T
from lurewatch.functions import urls as U
from lurewatch.operators import evaluation as V
from lurewatch.operators import fusion as FU
from lurewatch.operators import mail as M
from lurewatch.operators import routing as R
from lurewatch.operators import sampling as SA
from lurewatch.operators import texts as X
from lurewatch.operators import urls as UO
from lurewatch.operators import verdict_cache as C
from lurewatch.operators.experts import call_expert, expert_results
from lurewatch.plans.analysis import Analyzer
from lurewatch.plans.training import split_sizes as count_split
from lurewatch.plans.training import train_text_detector, train_url_detector
from lurewatch.session import materialise, scratch_path
from lurewatch.sources import tables as S
from lurewatch.sources.models import TextDetector, UrlDetector, model_metadata
from lurewatch.sources.verdict_store import VerdictStore
from lurewatch.streaming import mail as SM

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(*names):
    return [F.round(F.col(n) + F.lit(0.0), 6).alias(n) for n in names]


_trained, _locks, _lock = {}, {}, threading.Lock()


def _once(spark, sf, name, make):
    """Fitted models are made once per session and data folder; different ones may be made at the same time."""
    key = (spark.sparkContext.applicationId, sf, name)
    with _lock:
        own = _locks.setdefault(key, threading.Lock())
    with own:
        if key not in _trained:
            _trained[key] = make()
        return _trained[key]


# -- sources ---------------------------------------------------------------------------------------


@query
def load_url_training(spark, sf):
    """Url training rows through a CSV file, with features."""
    path = scratch_path(spark, "urls-csv")
    S.write_csv(I.labelled_urls(spark, sf), path)
    rows = S.load_url_training(spark, path)
    return rows.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "label", "url_length", "domain_length", "path_length",
        "num_digits", *rounded("url_entropy"),
    )


def _text_csv(spark, sf, text_name):
    """Documents as CSV, with missing, blank and NA texts among them."""
    rows = I.labelled_documents(spark, sf).withColumn(
        "text",
        F.expr(r"CASE doc_id % 11 WHEN 0 THEN 'NA' WHEN 1 THEN ' ' || chr(10) || ' ' WHEN 2 THEN NULL ELSE text END"),
    )
    path = scratch_path(spark, "texts-csv")
    S.write_csv(rows.withColumnRenamed("text", text_name), path)
    return path


@query
def load_text_training(spark, sf):
    rows = S.load_text_training(spark, _text_csv(spark, sf, "text"))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "label")


@query
def load_text_lenient(spark, sf):
    rows = S.load_text_lenient(spark, _text_csv(spark, sf, "message_body"))
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "label")


@query
def model_metadata_row(spark, sf):
    data = model_metadata(I.labelled_documents(spark, sf), "gbt_tfidf", "TF-IDF with boosted trees", K.MAX_FEATURES)
    pairs = F.array_sort(F.map_entries("id2label"))
    return data.select(
        "model_type", "num_labels",
        F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("id2label"),
        F.element_at("label2id", "PHISHING").alias("phishing_id"),
        "max_features", "note",
    )


# -- urls ------------------------------------------------------------------------------------------


@query
def url_split(spark, sf):
    return UO.split_urls(I.url_forms(spark, sf)).drop("url")


@query
def url_domain_parts(spark, sf):
    rows = UO.with_host_parts(I.url_forms(spark, sf))
    return rows.select("page_id", "form", "host_parts.*")


@query
def url_domain_parts_joined(spark, sf):
    """The same with the rules as a table that is joined, as for rule tables of any size."""
    rules = spark.createDataFrame([(r,) for r in K.DEFAULT_SUFFIXES], "rule string")
    return UO.with_host_parts(I.url_forms(spark, sf), suffixes=rules).select("page_id", "form", "host_parts.*")


@query
def url_features(spark, sf):
    rows = UO.url_features(I.url_forms(spark, sf))
    return rows.select("page_id", "form", *[c for c in K.URL_FEATURES if c not in K.ENTROPY_FEATURES],
                       *rounded(*K.ENTROPY_FEATURES))


def _some_features(spark, sf, *names):
    rows = UO.url_features(I.url_forms(spark, sf))
    plain = [n for n in names if n not in K.ENTROPY_FEATURES]
    return rows.select("page_id", "form", *plain, *rounded(*[n for n in names if n in K.ENTROPY_FEATURES]))


@query
def url_char_counts(spark, sf):
    return _some_features(spark, sf, *K.COUNTED_CHARS, "num_digits")


@query
def url_entropy(spark, sf):
    return _some_features(spark, sf, *K.ENTROPY_FEATURES)


@query
def url_host_flags(spark, sf):
    return _some_features(spark, sf, "has_ip_address", "is_https", "has_port")


@query
def url_tokens(spark, sf):
    return _some_features(spark, sf, "suspicious_token_count", "has_risky_tld")


# -- filters, samples, splits ----------------------------------------------------------------------


@query
def clean_text(spark, sf):
    rows = I.table(spark, sf, "documents").select(
        "doc_id",
        F.expr(r"CASE doc_id % 5 WHEN 0 THEN ' ' || chr(9) || chr(10) WHEN 1 THEN NULL ELSE ' ' || text END").alias("text"),
    )
    return X.clean_text(rows)


@query
def balanced_sample(spark, sf):
    rows = I.labelled_documents(spark, sf).select("doc_id", "label")
    return SA.balanced_sample(rows, sample_size=120)


@query
def stratified_split(spark, sf):
    return SA.stratified_split(I.labelled_documents(spark, sf).select("doc_id", "label"))


@query
def kfold_assign(spark, sf):
    return SA.assign_folds(I.labelled_documents(spark, sf).select("doc_id", "label"))


@query
def class_distribution(spark, sf):
    return SA.class_distribution(I.labelled_documents(spark, sf))


@query
def split_sizes(spark, sf):
    return count_split(SA.stratified_split(I.labelled_documents(spark, sf).select("doc_id", "label")))


# -- text ------------------------------------------------------------------------------------------


def _words(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("words"))


@query
def tokens(spark, sf):
    return _words(spark, sf).select(
        "doc_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("tokens")
    )


@query
def stopword_tokens(spark, sf):
    kept = _words(spark, sf).withColumn("words", T.without_stop_words(F.col("words")))
    return kept.select("doc_id", F.size("words").alias("n_tokens"), F.array_join("words", " ").alias("tokens"))


@query
def ngrams(spark, sf):
    rows = X.with_terms(I.table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


@query
def vocab_df(spark, sf):
    docs = I.table(spark, sf, "documents")
    frequencies = X.document_frequencies(docs)
    n_docs = docs.count()
    return frequencies.filter((F.col("df") >= K.MIN_DF) & (F.col("df") <= F.lit(K.MAX_DF * n_docs)))


@query
def vocab_topk(spark, sf):
    return X.fit_vocabulary(I.table(spark, sf, "documents")).select("term", "df", "tf", *rounded("idf"))


def _vectorizer(spark, sf):
    """The vectorizer of all documents, fitted once per session and data folder."""
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return _once(spark, sf, "vectorizer", lambda: X.TextVectorizer.fit(docs))


@query
def tfidf(spark, sf):
    rows = _vectorizer(spark, sf).long_form(I.table(spark, sf, "documents"), normalise=False)
    return rows.select("doc_id", "term", "tf", *rounded("tfidf"))


@query
def tfidf_l2(spark, sf):
    rows = _vectorizer(spark, sf).long_form(I.table(spark, sf, "documents"))
    return rows.select("doc_id", "term", "tf", *rounded("tfidf"))


@query
def tfidf_joined(spark, sf):
    """The same by a join, as for vocabularies of any size."""
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    vocabulary = materialise(X.fit_vocabulary(docs).select("term", "idf"), "vocabulary")
    return X.tfidf_joined(docs, vocabulary).select("doc_id", "term", "tf", *rounded("tfidf"))


@query
def tfidf_transform(spark, sf):
    """A vocabulary of the even documents applied to the odd ones."""
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    vectorizer = X.TextVectorizer.fit(docs.filter("doc_id % 2 = 0"))
    return vectorizer.long_form(docs.filter("doc_id % 2 = 1")).select("doc_id", "term", *rounded("tfidf"))


# -- models ----------------------------------------------------------------------------------------


def _url_training(spark, sf):
    rows = I.labelled_urls(spark, sf)
    return _once(spark, sf, "url", lambda: train_url_detector(rows, "page_id"))


def _text_training(spark, sf):
    rows = I.labelled_documents(spark, sf)
    return _once(spark, sf, "text", lambda: train_text_detector(rows, "doc_id"))


def _detectors(spark, sf):
    """The url and the text detector. Both are trained at the same time: a training is many short jobs, which leave cores idle."""
    with ThreadPoolExecutor(2) as pool:
        return [report.detector for report in pool.map(lambda training: training(spark, sf), (_url_training, _text_training))]


@query
def train_url_model(spark, sf):
    """Supports of the test report; whether all its metrics and the AUC lie in 0 to 1."""
    return _checked_report(_url_training(spark, sf))


@query
def train_text_model(spark, sf):
    return _checked_report(_text_training(spark, sf))


def _checked_report(report):
    inside = F.lit(True)
    for name in ("precision", "recall", "f1", "auc"):
        inside = inside & _in_range(name)
    rows = report.report.crossJoin(F.broadcast(report.auc))  # one row
    return rows.select("row", "support", inside.alias("in_range"))


def _in_range(name):
    """A metric is not outside 0 to 1; without rows of both classes it may be undefined."""
    return F.coalesce(F.col(name).between(0, 1), F.lit(True))


@query
def early_stopping(spark, sf):
    """How the url training ended: whether patience, the last round or a lack of splits ended it, whether the model has
    the trees up to the first best round, and whether the metrics lie in 0 to 1."""
    report = _url_training(spark, sf)
    history, kept = report.fit.history, report.fit.n_trees
    last, block = K.BOOSTER["num_boost_round"], K.BOOSTER["bagging_freq"]
    ended = {"patience": kept + K.PATIENCE <= len(history) < kept + K.PATIENCE + block, "rounds": len(history) == last,
             "no split": len(history) < kept + K.PATIENCE and kept <= len(history)}[report.fit.ended_by]
    first_best = not history or history.index(max(history)) + 1 == kept
    trees = report.detector.model.getNumTrees == kept
    stages = report.auc.select(F.lit(history).cast("array<double>").alias("auc"))
    return stages.select(
        F.lit(bool(ended)).alias("ended_rightly"), F.lit(bool(first_best and trees)).alias("best_trees_kept"),
        F.forall("auc", lambda x: x.between(0, 1)).alias("in_range"))


@query
def cv_auc(spark, sf):
    """Folds of the url training's cross-validation, their AUCs in 0 to 1, and whether the AUC of the test rows is that
    of the library's evaluator."""
    report = _url_training(spark, sf)
    folds = report.cv_folds.agg(F.count(F.lit(1)).alias("n_folds"), F.bool_and(_in_range("auc")).alias("in_range"))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    by_library = evaluator.evaluate(report.scored)
    same = report.auc.select(F.coalesce(F.abs(F.col("auc") - by_library) < 1e-9, F.lit(True)).alias("as_by_library"))
    return folds.crossJoin(F.broadcast(same))  # one row each


@query
def feature_importance(spark, sf):
    """The heaviest features of the trained url model: how many, whether heaviest first, and whether all shares make 1."""
    report = _url_training(spark, sf)
    total = sum(w for _, w in report.detector.importances())
    rows = report.importance.agg(F.collect_list("importance").alias("w"))  # ten numbers
    return rows.select(F.size("w").cast("bigint").alias("n_features"), (F.col("w") == F.sort_array("w", asc=False)).alias("sorted"),
                       F.lit(total == 0 or abs(total - 1) < 1e-9).alias("shares"))


@query
def score_url(spark, sf):
    """Every form of every url, missing and malformed ones too; whether score, label, confidence agree."""
    rows = _url_training(spark, sf).detector.score(I.url_forms(spark, sf))
    return rows.select("page_id", "form", _consistent("tier1_result"))


def _consistent(result):
    r = F.col(result)
    sure = F.abs(r["score"] - 0.5) >= 0.5 - (1 - r["metadata"]["threshold"])
    right = r["score"].between(0, 1) & (r["label"] == D.label(r["score"])) & (r["escalate"] == (r["confidence"] == "low"))
    return F.coalesce(right & sure.isNotNull(), F.lit(False)).alias("consistent")


@query
def score_text(spark, sf):
    rows = _text_training(spark, sf).detector.score(I.table(spark, sf, "documents").select("doc_id", "text"))
    length = F.col("tier2_result")["metadata"]["text_length"]
    return rows.select("doc_id", _consistent("tier2_result"), length.alias("text_length"))


@query
def score_contract(spark, sf):
    """Every text score keeps the result contract, whatever the model."""
    rows = _text_training(spark, sf).detector.score(I.table(spark, sf, "documents").select("doc_id", "text"))
    checked = V.result_violations(rows, "tier2_result", tier=2)
    return checked.select("doc_id", F.size("violations").alias("n_violations"),
                          F.col("tier2_result")["metadata"]["text_length"].alias("text_length"))


@query
def model_roundtrip(spark, sf):
    """Score drift between detectors and their saved and loaded copies: none."""
    url, text = _detectors(spark, sf)
    path = scratch_path(spark, "models")
    url.save(spark, f"{path}/url")
    text.save(spark, f"{path}/text")
    messages = I.messages(spark, sf)

    def scores(u, t):
        rows = t.score(u.score(messages))
        s1, s2 = F.col("tier1_result")["score"], F.col("tier2_result")["score"]
        return rows.select("msg_id", (F.coalesce(s1, F.lit(-1)) + 10 * F.coalesce(s2, F.lit(-1))).alias("score"))

    before = materialise(scores(url, text), "scores")  # read twice
    after = scores(UrlDetector.load(spark, f"{path}/url"), TextDetector.load(spark, f"{path}/text"))
    drift = V.score_drift(before, after, ids="msg_id")
    return drift.agg(F.count(F.lit(1)).alias("n_drifted")).crossJoin(before.agg(F.count("score").alias("n_scored")))


# -- scoring decisions -----------------------------------------------------------------------------


@query
def tier_decision(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("id"))
    scored = docs.withColumn("score", F.coalesce(F.expr(I.SCORE1), F.lit(0.15)))
    r = D.tier_result(F.col("score"), D.text_metadata(F.col("text")))
    return scored.select("doc_id", r.alias("r")).select(
        "doc_id", "r.score", "r.label", "r.confidence", "r.escalate", "r.metadata.tier", "r.metadata.model",
        "r.metadata.threshold", "r.metadata.text_length",
    )


@query
def top_features(spark, sf):
    weights = [(name, float(i * 7 % 18)) for i, name in enumerate(K.URL_FEATURES)]
    rows = UO.url_features(I.url_forms(spark, sf)).withColumn("top", D.top_features(weights))
    return rows.select("page_id", "form", F.posexplode_outer("top").alias("rank", "t")).select(
        "page_id", "form", "rank", F.col("t.feature").alias("feature"),
        F.round(F.col("t.value") + F.lit(0.0), 6).alias("value"), F.col("t.importance").alias("importance"),
    )


@query
def result_violations(spark, sf):
    rows = I.order_scores(spark, sf, I.BAD_SCORE1, I.BAD_SCORE2)
    good = D.tier_result(F.col("tier1_score"), D.text_metadata(F.lit("text")))
    label = F.when(F.col("id") % 5 == 0, "spam").otherwise(good["label"])
    confidence = F.when(F.col("id") % 19 == 0, "medium").otherwise(good["confidence"])
    tier = F.when(F.col("id") % 23 == 0, 1).otherwise(2)
    r = good.withField("label", label).withField("confidence", confidence).withField("metadata.tier", tier)
    checked = V.result_violations(rows.withColumn("result", r), tier=2)
    return checked.select("id", F.array_join("violations", ";").alias("violations"))


@query
def score_drift(spark, sf):
    left = I.order_scores(spark, sf).select("id", F.coalesce("tier1_score", F.lit(0.5)).alias("score"))
    moved = F.when(F.col("id") % 6 == 0, F.col("score") + 1e-6).when(
        F.col("id") % 6 == 1, F.col("score") + 1e-12
    ).otherwise(F.col("score"))
    return V.score_drift(left, left.withColumn("score", moved)).select("id", *rounded("score_a"))


@query
def softmax_binary(spark, sf):
    lines = I.line_scores(spark, sf).select(
        "id", F.expr(I.LOGIT0).alias("logit0"), F.expr(I.LOGIT1).alias("logit1")
    )
    p = D.softmax_of_two(F.col("logit0"), F.col("logit1"))
    return lines.select(
        "id", F.round(p, 6).alias("score"), F.when(F.col("logit1") > F.col("logit0"), 1).otherwise(0).alias("prediction")
    )


# -- evaluation ------------------------------------------------------------------------------------


@query
def confusion_matrix(spark, sf):
    return V.confusion_matrix(I.line_scores(spark, sf))


@query
def classification_report(spark, sf):
    return V.classification_report(I.line_scores(spark, sf)).select(
        "row", *rounded("precision", "recall", "f1"), "support"
    )


@query
def binary_metrics(spark, sf):
    return V.binary_metrics(I.line_scores(spark, sf)).select(*rounded("accuracy", "precision", "recall", "f1"))


@query
def roc_auc(spark, sf):
    return V.roc_auc(I.line_scores(spark, sf)).select(*rounded("auc"))


@query
def roc_auc_by_part(spark, sf):
    """The same per group, with almost every score different."""
    lines = I.line_scores(spark, sf).select(
        (F.col("id") % 3).alias("part"), "label", (F.col("score") + F.col("id") / F.lit(1e9)).alias("score")
    )
    return V.roc_auc(lines, by=["part"]).select("part", *rounded("auc"))


def _cases(spark, sf):
    return I.line_scores(spark, sf).select(
        "id", "score", D.label(F.col("score")).alias("label"),
        F.when(F.col("label") == 1, K.PHISHING).otherwise(K.BENIGN).alias("expected"),
    )


@query
def accuracy_gate(spark, sf):
    return V.accuracy_gate(_cases(spark, sf))


@query
def misclassified(spark, sf):
    return V.misclassified(_cases(spark, sf))


# -- fusion ----------------------------------------------------------------------------------------


def _flat_fusion(fused):
    f = F.col("fusion")
    return fused.select(
        "id", f["score"].alias("score"), f["label"].alias("label"), f["risk_level"].alias("risk_level"),
        f["confidence"].alias("confidence"), f["escalate"].alias("escalate"),
        f["metadata"]["tier1_score"].alias("tier1_score"), f["metadata"]["tier2_score"].alias("tier2_score"),
        F.get(f["metadata"]["weights"], F.lit(0)).alias("weight1"),
        F.get(f["metadata"]["weights"], F.lit(1)).alias("weight2"),
        f["metadata"]["fusion_method"].alias("fusion_method"),
    )


@query
def fuse_scores(spark, sf):
    return _flat_fusion(FU.fuse_scores(I.order_scores(spark, sf)))


@query
def fuse_scores_weighted(spark, sf):
    return _flat_fusion(FU.fuse_scores(I.order_scores(spark, sf), weights=(0.7, 0.2), zone=(0.25, 0.75)))


@query
def fusion_rejects(spark, sf):
    rows = I.order_scores(spark, sf, I.BAD_SCORE1, I.BAD_SCORE2)
    return FU.fusion_rejects(rows).select("id", "reject_reason")


@query
def risk_levels(spark, sf):
    rows = FU.fuse_scores(I.order_scores(spark, sf)).select("fusion.risk_level")
    return rows.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query
def fusion_reasoning(spark, sf):
    fused = FU.fuse_scores(I.order_scores(spark, sf))
    reasons = D.fusion_reasons(F.col("tier1_score"), F.col("tier2_score"), F.col("fusion.risk_level"))
    return fused.select("id", F.array_join(reasons, "|").alias("reasoning"))


# -- routing ---------------------------------------------------------------------------------------


class _GivenScores:
    """A stand-in for a detector whose scores are a formula of the message id."""

    def __init__(self, given, formula, metadata, result):
        self.given, self.formula, self.metadata, self.result = given, formula, metadata, result

    def score(self, df):
        score = F.coalesce(F.expr(self.formula.replace("id", "msg_id")), F.lit(0.5))
        tier = D.tier_result(score, self.metadata)
        return df.withColumn(self.result, F.when(F.coalesce(F.col(self.given), F.lit("")) != "", tier))


def _analyzer_with_given_scores(store=None):
    no_features = F.array().cast("array<struct<feature:string,value:double,importance:double>>")
    return Analyzer(
        _GivenScores("url", I.SCORE1, D.url_metadata(no_features), "tier1_result"),
        _GivenScores("text", I.SCORE2, D.text_metadata(F.col("text")), "tier2_result"),
        make_expert=I.make_expert, expert_model="stub", expert_partitions=8, store=store,
    )


@query
def route_inputs(spark, sf):
    return R.route_inputs(I.messages(spark, sf)).select("msg_id", "run_tier1", "run_tier2", "reject_reason")


@query
def escalation_queue(spark, sf):
    fused = _analyzer_with_given_scores().fuse(I.messages(spark, sf))
    return R.escalation_queue(fused).select("msg_id", "force_expert", F.col("fusion.escalate").alias("escalate"))


@query
def final_verdicts(spark, sf):
    verdicts = _analyzer_with_given_scores().analyze(I.messages(spark, sf), now=I.NOW)
    return verdicts.select("msg_id", "result", "risk_level", "confidence",
                           F.array_join("reasoning", "|").alias("reasoning"), "tier_used")


@query
def verdict_details(spark, sf):
    verdicts = _analyzer_with_given_scores().analyze(I.messages(spark, sf), now=I.NOW)
    d = F.col("details")
    return verdicts.select(
        "msg_id",
        d["tier1_result"]["score"].alias("tier1_score"), d["tier1_result"]["confidence"].alias("tier1_confidence"),
        d["tier2_result"]["score"].alias("tier2_score"),
        d["tier2_result"]["metadata"]["text_length"].alias("text_length"),
        d["fusion_result"]["metadata"]["fusion_method"].alias("fusion_method"),
        d["tier3_result"]["result"].alias("tier3_result"), d["tier3_result"]["confidence"].alias("tier3_confidence"),
        d["tier3_result"]["metadata"]["tokens"].alias("tokens"),
    )


@query
def cached_verdicts(spark, sf):
    """A second run over the same messages: everything but failed calls comes from the cache."""
    store = VerdictStore(spark, scratch_path(spark, "verdicts"))
    analyzer = _analyzer_with_given_scores(store)
    messages = I.messages(spark, sf)
    analyzer.analyze(messages, now=I.NOW)
    second = analyzer.analyze(messages, now=I.NOW + 3600)
    m = F.col("details.tier3_result.metadata")
    return second.filter("tier_used = '3'").select(
        "msg_id", "result", m["cache_hit"].alias("cache_hit"), m["tokens"].alias("tokens"), m["error"].alias("error")
    )


@query
def routing_stats(spark, sf):
    verdicts = _analyzer_with_given_scores().analyze(I.messages(spark, sf), now=I.NOW)
    return V.routing_stats(verdicts)


def flagship(spark, sf):
    """Trained detectors, fusion, expert: one verdict row per message."""
    analyzer = Analyzer(
        *_detectors(spark, sf),
        make_expert=I.make_expert, expert_model="stub", expert_partitions=8,
        store=VerdictStore(spark, scratch_path(spark, "verdicts")),
    )
    return analyzer.analyze(I.messages(spark, sf), now=I.NOW)


@query
def analyze(spark, sf):
    """Every message has a known result, and its details agree with the tier that decided."""
    verdicts = flagship(spark, sf)
    known = F.col("result").isin(K.PHISHING, K.BENIGN, K.SAFE)
    same = F.col("details.fusion_result.score").between(0, 1) & (
        (F.col("tier_used") == "3") == F.col("details.tier3_result").isNotNull())
    return verdicts.select("msg_id", F.coalesce(known, F.lit(False)).alias("has_result"), F.coalesce(same, F.lit(False)).alias("consistent"))


@query
def message_outcomes(spark, sf):
    """Every message once: with its verdict, or with the reason why it has none."""
    verdicts, rejects = _analyzer_with_given_scores().analyze_all(I.messages(spark, sf), now=I.NOW)
    none = F.lit(None).cast("string")
    return verdicts.select("msg_id", "result", none.alias("reject_reason")).unionByName(
        rejects.select("msg_id", none.alias("result"), "reject_reason"))


@query
def skip_cache(spark, sf):
    """A second run that leaves the cache aside: every expert row is asked for again."""
    analyzer = _analyzer_with_given_scores(VerdictStore(spark, scratch_path(spark, "verdicts")))
    messages = I.messages(spark, sf)
    analyzer.analyze(messages, now=I.NOW)
    second = analyzer.analyze(messages, now=I.NOW + 3600, skip_cache=True)
    hit = F.col("details.tier3_result.metadata.cache_hit")
    return second.filter("tier_used = '3'").select("msg_id", "result", hit.alias("cache_hit"))


# -- expert and cache ------------------------------------------------------------------------------


@query
def expert_prompt(spark, sf):
    return I.messages(spark, sf).select("msg_id", E.prompt(F.col("url"), F.col("text")).alias("prompt"))


@query
def expert_batch(spark, sf):
    """Each different message once to the stand-in expert."""
    queue = C.with_cache_key(R.accepted(I.messages(spark, sf)))
    requests = C.misses(queue, None, I.NOW, skip_cache=True)
    results = expert_results(call_expert(requests, I.make_expert, partitions=8), "stub")
    r = F.col("tier3_result")
    return results.select(
        "cache_key", r["result"].alias("result"), r["confidence"].alias("confidence"),
        F.array_join(r["reasoning"], "|").alias("reasoning"), r["metadata"]["tokens"].alias("tokens"),
        r["metadata"]["error"].alias("error"),
    )


@query
def parse_verdict(spark, sf):
    return I.responses(spark, sf).select("doc_id", E.verdict(F.col("response_text")).alias("verdict"))


@query
def parse_reasoning(spark, sf):
    reasons = E.reasons(F.col("response_text"))
    return I.responses(spark, sf).select("doc_id", F.array_join(reasons, "|").alias("reasoning"))


def _flat_result(spark, sf, failed):
    rows = I.responses(spark, sf).withColumn("r", E.expert_result("stub"))
    m = F.col("r.metadata")
    keep = F.col("status") != "ok" if failed else F.col("status") == "ok"
    return rows.filter(keep).select(
        "doc_id", F.col("r.result").alias("result"), F.col("r.confidence").alias("confidence"),
        F.array_join("r.reasoning", "|").alias("reasoning"), m["tier"].alias("tier"), m["model"].alias("model"),
        m["tokens"].alias("tokens"), m["cache_hit"].alias("cache_hit"),
        m["response_time_ms"].alias("response_time_ms"), m["error"].alias("error"),
    )


@query
def expert_result(spark, sf):
    return _flat_result(spark, sf, failed=False)


@query
def expert_fallback(spark, sf):
    return _flat_result(spark, sf, failed=True)


@query
def cache_key(spark, sf):
    shouted = F.concat(F.lit(" "), F.upper("url"), F.lit("\t"))
    padded = F.concat(F.lit("\n "), F.col("text"), F.lit("  "))
    return I.messages(spark, sf).select("msg_id", E.cache_key(shouted, padded).alias("cache_key"))


def _cache_rows(spark, sf):
    """Two generations of stored verdicts; ages run from 0 to 47 hours."""
    rows = C.with_cache_key(I.messages(spark, sf)).filter("msg_id % 3 <> 0")
    age = F.explode(F.array((F.col("msg_id") * 5) % 48, (F.col("msg_id") * 11) % 48)).alias("age")
    rows = rows.select("cache_key", "msg_id", age)
    result = F.struct(
        F.when(F.col("age") % 2 == 0, K.SAFE).otherwise(K.PHISHING).alias("result"),
        F.lit(1.0).alias("confidence"),
        F.array(F.concat(F.lit("age "), F.col("age").cast("string"))).alias("reasoning"),
        F.struct(
            F.lit(3).alias("tier"), F.lit("stub").alias("model"), F.col("age").cast("int").alias("tokens"),
            F.lit(False).alias("cache_hit"), F.lit(9).cast("bigint").alias("response_time_ms"),
        ).alias("metadata"),
    )
    created = F.lit(I.NOW) - F.col("age").cast("double") * F.lit(3600.0)
    return rows.select("cache_key", F.to_json(result).alias("response_json"), created.alias("created_at"))


@query
def cache_lookup(spark, sf):
    messages = C.with_cache_key(I.messages(spark, sf)).select("msg_id", "cache_key")
    found = C.lookup(messages, _cache_rows(spark, sf), I.NOW, response_time_ms=3)
    c = F.col("cached")
    return found.select(
        "msg_id", c["result"].alias("result"), F.get(c["reasoning"], F.lit(0)).alias("reason"),
        c["metadata"]["tokens"].alias("tokens"), c["metadata"]["cache_hit"].alias("cache_hit"),
        c["metadata"]["response_time_ms"].alias("response_time_ms"),
    )


@query
def cache_store_lookup(spark, sf):
    """The same from a store, which reads the parts of the batch's keys."""
    messages = materialise(C.with_cache_key(I.messages(spark, sf)).select("msg_id", "cache_key"), "messages")
    store = VerdictStore(spark, scratch_path(spark, "verdicts"))
    store.put(_cache_rows(spark, sf))
    c = F.col("cached")
    return store.lookup(messages, I.NOW).select(
        "msg_id", c["result"].alias("result"), c["metadata"]["tokens"].alias("tokens"), c["metadata"]["cache_hit"].alias("cache_hit"))


@query
def cache_misses(spark, sf):
    messages = C.with_cache_key(I.messages(spark, sf))
    return C.misses(messages, _cache_rows(spark, sf), I.NOW).select("cache_key", "n_messages")


@query
def cache_upsert(spark, sf):
    rows = _cache_rows(spark, sf)
    old, new = rows.filter(F.col("created_at") < I.NOW - 86400), rows.filter(F.col("created_at") >= I.NOW - 86400)
    table = C.upsert(old, new)
    return table.select("cache_key", "created_at", F.get_json_object("response_json", "$.result").alias("result"))


@query
def cache_stats(spark, sf):
    return C.stats(C.latest(_cache_rows(spark, sf)))


@query
def cache_store(spark, sf):
    """The stored table: put twice, compacted, and its statistics after that."""
    rows = _cache_rows(spark, sf)
    store = VerdictStore(spark, scratch_path(spark, "verdicts"))
    store.put(rows.filter(F.col("created_at") < I.NOW - 86400))
    store.put(rows.filter(F.col("created_at") >= I.NOW - 86400))
    store.compact(drop_expired_at=I.NOW)
    return store.stats()


@query
def cache_cleared(spark, sf):
    store = VerdictStore(spark, scratch_path(spark, "verdicts"))
    store.put(_cache_rows(spark, sf))
    before = store.stats().select(F.col("entry_count").alias("before"))
    store.clear()
    return before.crossJoin(store.stats().select(F.col("entry_count").alias("after")))  # one row each


# -- opened mail -----------------------------------------------------------------------------------


def _mail(spark, sf):
    return I.mail_events(I.table(spark, sf, "events"))


def _mail_stream(spark, sf):
    """The events table as a stream of files."""
    schema = I.table(spark, sf, "events").schema
    return I.mail_events(SM.read_events(spark, f"{sf}/events.parquet*", schema, format="parquet"))


@query
def mail_id(spark, sf):
    return M.opened_mail(_mail(spark, sf)).select("event_id", "mail_id")


@query
def mail_opens(spark, sf):
    return M.drop_repeats(M.opened_mail(_mail(spark, sf))).select("event_id", "session_id", "mail_id")


@query
def mail_opens_stream(spark, sf):
    """Events that arrive in three files, one micro-batch each, with a restart after every one."""
    path = scratch_path(spark, "opens")
    events = I.table(spark, sf, "events")
    cuts = events.select(F.percentile_approx(F.col("ts").cast("timestamp").cast("double"), [0.33, 0.67]).alias("c")).first()["c"]
    part = sum((F.col("ts").cast("timestamp").cast("double") > c).cast("int") for c in cuts)
    for i in range(3):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(f"{path}/events")
        stream = SM.read_events(spark, f"{path}/events", events.schema, format="parquet", max_files_per_trigger=1)
        opened = M.opened_mail(I.mail_events(stream))
        columns = ["event_id", "session_id", "mail_id"]
        SM.run_to_end(SM.write_changes(opened, path, f"{path}/progress", columns=columns))
    return SM.read_changes(spark, path, opened.select(columns).schema)


@query
def mail_payload(spark, sf):
    rows = M.with_payload(_mail(spark, sf))
    p = F.from_json(F.to_json("payload"), "struct<email: string, name: string, content: string>")
    return rows.select("event_id", "type", p.alias("p")).select("event_id", "type", "p.*")


def _typed_payload(events):
    payload = F.struct("email", "name", "content").alias("payload")
    return events.select("type", payload, "session_id", "ts", "event_id")


@query
def mail_dashboard(spark, sf):
    listed = M.dashboard(M.only_opened(_typed_payload(_mail(spark, sf))))
    return listed.select("event_id", "email", "name", "content")


def _captured(spark, sf):
    path = scratch_path(spark, "mail")
    events = _typed_payload(_mail_stream(spark, sf))
    SM.run_to_end(SM.write_capture(events, f"{path}/store", f"{path}/progress"))
    return f"{path}/store"


@query
def stream_capture(spark, sf):
    stored = spark.read.parquet(_captured(spark, sf))
    return stored.select("event_id", "type", "payload.*", "session_id")


@query
def stream_score(spark, sf):
    """Captured mail scored batch by batch with trained detectors; urls come from the contents."""
    captured = _captured(spark, sf)
    schema = spark.read.parquet(captured).schema
    analyzer = Analyzer(
        *_detectors(spark, sf),
        make_expert=I.make_expert, expert_model="stub", expert_partitions=8,
    )
    path = scratch_path(spark, "scores")
    stream = SM.read_events(spark, captured, schema, format="parquet")
    SM.run_to_end(SM.write_scores(stream, analyzer, f"{path}/out", f"{path}/progress", now=I.NOW))
    scored, refused = spark.read.parquet(f"{path}/out/verdicts"), spark.read.parquet(f"{path}/out/rejects")
    tiers = F.col("details.tier1_result").isNotNull() | F.col("details.tier2_result").isNotNull()
    known = F.col("result").isin(K.PHISHING, K.BENIGN, K.SAFE)
    return scored.select("msg_id", "url", tiers.alias("has_tier1"), known.alias("has_result"), F.lit(None).cast("string").alias("reject_reason")).unionByName(
        refused.select("msg_id", "url", F.lit(False).alias("has_tier1"), F.lit(False).alias("has_result"), "reject_reason"))


QUERIES["model_metadata"] = QUERIES.pop("model_metadata_row")
