"""Text operators, sources and models."""

import unicodedata

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.catalog import queries as Q
from lurewatch.operators import sampling as SA
from lurewatch.operators import texts as X
from lurewatch.operators import boosting as B
from lurewatch.session import scratch_path
from lurewatch.sources import tables as S
from lurewatch.sources.models import TextDetector, UrlDetector


def write_text(spark, name, content):
    path = scratch_path(spark, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)
    return path


def test_stop_words_are_those_of_spark(spark):
    assert K.ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_csv_bad_lines(spark):
    path = write_text(spark, "texts", 'message_body,label\n"a, ""b""\nc",1\nx,0,surplus\nextra,0,\nmore,0,,y\nshort\nNA,1\nok,0.0\n')
    with pytest.raises(Exception, match="more fields"):
        S.read_csv(spark, path).collect()
    with pytest.raises(ValueError, match="missing columns"):
        S.load_text_training(spark, path)
    with pytest.raises(Exception, match="label is missing"):
        S.load_text_lenient(spark, path).collect()
    rows = S.read_csv(spark, path, on_bad_lines="skip").collect()
    assert [tuple(r) for r in rows] == [('a, "b"\nc', "1"), ("short", None), (None, "1"), ("ok", "0.0")]


def test_csv_headers_must_agree(spark):
    folder = scratch_path(spark, "two")
    import os

    os.makedirs(folder)
    for name, content in (("a.csv", "text,label\na,1\n"), ("b.csv", "label,text\n0,b\n")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(content)
    with pytest.raises(Exception):
        S.read_csv(spark, folder).collect()


@pytest.mark.parametrize("column", ["label", "doc_id"])
def test_splits_refuse_rows_without_label_or_id(spark, column):
    df = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    df = df.withColumn(column, F.when(F.col("doc_id") > 5, F.col(column)))
    for part in (SA.stratified_split, SA.assign_folds, lambda d: SA.balanced_sample(d, 20)):
        with pytest.raises(Exception, match=f"{column} is missing"):
            part(df).collect()


def test_buckets_grow_with_the_table():
    assert SA.hex_digits(1000) == 3 and SA.hex_digits(10**9) == 4 and SA.hex_digits(10**11) == 6


def test_url_training_rows(spark):
    path = write_text(spark, "urls", "url,label\nhttp://fake-bank.tk,1\n,0\n")
    rows = S.load_url_training(spark, path).orderBy("label").collect()
    assert [r["url_length"] for r in rows] == [0, 19]


def test_balanced_sample_sizes(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in SA.class_distribution(SA.balanced_sample(df, 300)).collect()}
    assert sizes == {0: 150, 1: 100}
    assert SA.balanced_sample(df, 1000).count() == 1000
    a = {r["doc_id"] for r in SA.balanced_sample(df.repartition(9), 300).collect()}
    assert a == {r["doc_id"] for r in SA.balanced_sample(df, 300).collect()}


def test_folds_like_unshuffled_stratified_folds(spark):
    labels = [1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1, 0, 0]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id int, label int")
    folds = [r["fold"] for r in SA.assign_folds(df, folds=3).orderBy("doc_id").collect()]
    # Class 1 comes first: positions 0-3 give folds 0,1,2,0; class 0 takes positions 4-12.
    assert [f for f, y in zip(folds, labels) if y == 1] == [0, 0, 1, 2]
    assert [f for f, y in zip(folds, labels) if y == 0] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_vocabulary_and_unknown_terms(spark):
    rows = [(1, "Pay NOW pay"), (2, "pay later café"), (3, "Cafe closed"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    vectorizer = X.TextVectorizer.fit(df, config=X.TextConfig(max_df=1.0))
    assert vectorizer.terms == ["cafe", "pay"]
    assert {(r["doc_id"], r["term"], r["tf"]) for r in vectorizer.long_form(df).collect()} == {
        (1, "pay", 2), (2, "pay", 1), (2, "cafe", 1), (3, "cafe", 1)}
    unknown = spark.createDataFrame([(9, "zzz yyy")], "doc_id int, text string")
    assert vectorizer.transform(unknown).first()["features"].numNonzeros() == 0


def test_vectorizing_needs_no_shuffle_and_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = X.TextVectorizer(["a"], [1.0]).long_form(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("values, patience, kept", [
    ([0.5, 0.6, 0.7, 0.7, 0.7], 2, 3), ([0.5, 0.4, 0.4, 0.9], 2, 1), ([0.5, 0.4, 0.9], 2, 3), ([0.5], 50, 1),
])
def test_patience(values, patience, kept):
    assert B.best_stage(values, patience, True) == kept


def test_url_training_on_separable_data(spark):
    rows = [(i, f"http://{'secure-login.tk' if i % 2 else 'www.example.com'}/{i}", i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "page_id int, url string, label int")
    report = Q.train_url_detector(df, "page_id", num_boost_round=4, max_depth=2, reuse_test_as_valid=True)
    assert report.auc.first()["auc"] > 0.95
    assert report.cv_folds.count() == K.N_FOLDS
    assert 1 <= report.fit.n_trees <= 4 and len(report.fit.history) == 4
    sizes = {r["is_test"]: r["n_rows"] for r in report.split_sizes.collect()}
    assert sizes == {True: 48, False: 192}
    assert report.importance.count() == 10


def test_saved_models(spark, sf):
    with pytest.raises(FileNotFoundError, match="no saved model"):
        UrlDetector.load(spark, scratch_path(spark, "nothing"))
    detector = Q._text_training(spark, sf).detector
    path = scratch_path(spark, "model")
    detector.save(spark, path)
    copy = TextDetector.load(spark, path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(50)
    a, b = ({r["doc_id"]: r["tier2_result"]["score"] for r in d.score(docs).collect()} for d in (detector, copy))
    assert a == b and all(0 <= s <= 1 for s in a.values())


def test_a_filter_on_a_score_does_not_repeat_the_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    scored = Q._text_training(spark, sf).detector.score(docs)

    def tokenisations(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")

    assert tokenisations(scored.filter("tier2_result.score > 0.5")) == tokenisations(scored)


def test_terms_joined_with_a_vocabulary_move_once(spark):
    """Only known terms are shuffled, once, by document; rows with one id are one document."""
    rows = [(1, "pay now pay"), (1, "pay later"), (2, "later later"), (None, "now"), (None, "now pay"), (3, ""), (4, None), (5, "zzz")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    vocabulary = spark.createDataFrame([("pay", 2.0), ("later", 3.0), ("pay later", 1.0)], "term string, idf double")
    out = X.tfidf_joined(df, F.broadcast(vocabulary), normalise=False)
    assert {(r["doc_id"], r["term"], r["tf"], r["tfidf"]) for r in out.collect()} == {
        (1, "pay", 3, 6.0), (1, "later", 1, 3.0), (1, "pay later", 1, 1.0), (2, "later", 2, 6.0), (None, "pay", 1, 2.0)}
    plan = X.tfidf_joined(df, F.broadcast(vocabulary))._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_characters_that_become_several_are_found_without_a_class(spark):
    """A search with a class of many ranges took most of the time of tokens."""
    from lurewatch.functions import strings as ST

    df = spark.createDataFrame([("ﬁn é ß ½ 한글 각 𝐀 ㎏ ǆ",), ("naïve",), ("plain",), ("",), (None,)], "t string")
    out = df.select(ST.strip_accents(F.col("t")).alias("t"))
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert [r["t"] for r in out.collect()] == [None if r["t"] is None else plain(r["t"]) for r in df.collect()]
    assert "RLIKE" not in (p := out._jdf.queryExecution().optimizedPlan().toString()) and "regexp_like" not in p


def test_texts_are_split_without_being_moved_and_rows_with_one_id_keep_their_own(spark, monkeypatch):
    """Splits joined and shuffled whole texts, once for each branch of each split."""
    from lurewatch.plans import training as P

    rows = [(i // 2, f"text {i}", i % 3 == 0) for i in range(120)]  # every id twice, with other texts and labels
    frame = spark.createDataFrame(rows, "doc_id int, text string, label boolean").withColumn("label", F.col("label").cast("int"))
    split, columns = P._parts, []
    monkeypatch.setattr(P, "_parts", lambda df, *args: columns.append(df.columns) or split(df, *args))
    found = P._parts_of_texts(frame, "doc_id", 0.2, 42, False)
    assert [c for c in columns if "text" in c] == [] and columns
    assert sorted(found.columns) == ["doc_id", "is_test", "label", "part", "text"]
    assert sorted((r["doc_id"], r["text"], r["label"] == 1) for r in found.collect()) == sorted(rows)
    sizes = {r["part"]: r["count"] for r in found.groupBy("part").count().collect()}
    assert sizes["test"] == 24 and sizes["valid"] == 20 and sizes["fit"] == 76
    with pytest.raises(Exception, match="label is missing"):
        P._parts_of_texts(frame.withColumn("label", F.expr("CASE WHEN doc_id > 3 THEN label END")), "doc_id", 0.2, 42, False).collect()


def test_accents_are_looked_for_beyond_ascii(spark):
    """Whole texts were searched, character by character, and texts without an accent were written anew."""
    from lurewatch.functions.strings import strip_accents

    texts = ["plain", "“quoted” – no accent", "Ça va, naïve", "ﬁne ½ 한글 é", "", None, "日本語", "é", "…" * 3]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_accents(F.col("t")).alias("s"))
    for t, s in frame.collect():
        plain = None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        assert s == plain
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "[\\x00-\\x7f]" in plan


def test_a_roundtrip_scores_messages_once_by_each_model(spark, sf, monkeypatch):
    """Scores before saving were computed for the comparison and once more for their number."""
    seen, drift = [], Q.V.score_drift
    monkeypatch.setattr(Q.V, "score_drift", lambda before, after, **names: seen.append(before) or drift(before, after, **names))
    out = Q.model_roundtrip(spark, sf).first()
    assert out["n_drifted"] == 0 and out["n_scored"] == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert "regexp_extract_all(" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
