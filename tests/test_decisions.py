"""Fusion, parsing, cache and routing on golden rows."""

import pytest
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.catalog import inputs as I
from lurewatch.catalog.queries import _analyzer_with_given_scores
from lurewatch.functions import decisions as D
from lurewatch.functions import experts as E
from lurewatch.operators import evaluation as V
from lurewatch.operators import fusion as FU
from lurewatch.operators import mail as M
from lurewatch.operators import verdict_cache as C
from lurewatch.schemas import MESSAGES, VERDICT_CACHE
from lurewatch.session import scratch_path
from lurewatch.sources.verdict_store import VerdictStore

SCORES = "id int, tier1_score double, tier2_score double"


@pytest.mark.parametrize("s1, s2, score, label, risk, escalate, method", [
    (0.95, 0.88, 0.915, "phishing", "High", False, "weighted_average"),
    (0.08, 0.12, 0.10, "benign", "Low", False, "weighted_average"),
    (0.45, 0.55, 0.50, "phishing", "Medium", True, "weighted_average"),
    (0.92, 0.50, 0.71, "phishing", "High", False, "weighted_average"),
    (0.85, None, 0.85, "phishing", "High", False, "tier1_only"),
    (None, 0.22, 0.22, "benign", "Low", False, "tier2_only"),
    (0.90, 0.10, 0.50, "phishing", "Medium", False, "weighted_average"),
    (0.30, 0.70, 0.50, "phishing", "Medium", True, "weighted_average"),
])
def test_fusion(spark, s1, s2, score, label, risk, escalate, method):
    row = FU.fuse_scores(spark.createDataFrame([(1, s1, s2)], SCORES)).first()["fusion"]
    assert row["score"] == pytest.approx(score)
    assert (row["label"], row["risk_level"], row["escalate"]) == (label, risk, escalate)
    assert row["metadata"]["fusion_method"] == method
    assert row["confidence"] == ("low" if escalate else "high")


def test_fusion_rejects_and_strict(spark):
    rows = [(1, None, None), (2, 1.2, 0.5), (3, float("nan"), 0.5), (4, 0.5, 0.5)]
    df = spark.createDataFrame(rows, SCORES)
    assert {r["id"] for r in FU.fusion_rejects(df).collect()} == {1, 2, 3}
    assert [r["id"] for r in FU.fuse_scores(df).collect()] == [4]
    with pytest.raises(Exception, match="Tier 1 score lies outside"):
        FU.fuse_scores(df.filter("id > 1"), strict=True).collect()
    with pytest.raises(ValueError):
        D.fusion_result(F.lit(0.5), F.lit(0.5), weights=(1, -1))


def test_incomplete_tier_result_is_refused(spark):
    tier = "struct<score: double, label: string, confidence: string, escalate: boolean>"
    rows = [(1, (0.9, "phishing", "high", False), None), (2, (0.9, None, "high", False), None), (3, None, None)]
    df = spark.createDataFrame(rows, f"id int, tier1_result {tier}, tier2_result {tier}")
    assert [r["id"] for r in FU.fuse_tier_results(df).collect()] == [1]


@pytest.mark.parametrize("value, text", [(0.125, "0.12"), (0.145, "0.14"), (0.155, "0.15"), (0.7, "0.70")])
def test_two_decimals(spark, value, text):
    reasons = spark.range(1).select(D.fusion_reasons(F.lit(value), F.lit(None).cast("double"), F.lit("Low"))).first()[0]
    assert f"(score: {text})" in reasons[0] and len(reasons) == 2


@pytest.mark.parametrize("response, verdict, reasons", [
    ("VERDICT: safe\nREASONING:\n- a\n- b \n- c\n- d", "safe", ["a", "b", "c"]),
    ("VERDICT: [phishing]\nREASONING:\nThis is well-known\n- one\n- two\n-\n- three", "phishing", ["known", "one", "two"]),
    ("nothing here", "phishing", [K.NO_REASON]),
    ("verdict:\tSAFE", "safe", [K.NO_REASON]),
])
def test_parsing(spark, response, verdict, reasons):
    df = spark.createDataFrame([(response,)], "r string")
    assert tuple(df.select(E.verdict(F.col("r")), E.reasons(F.col("r"))).first()) == (verdict, reasons)


def test_cache_key_ignores_case_of_url_and_outer_space(spark):
    df = spark.createDataFrame([("HTTP://TEST.COM", "  test text  "), ("http://test.com ", "test text")], "url string, text string")
    assert df.select(E.cache_key(F.col("url"), F.col("text"))).distinct().count() == 1


def test_store_put_get_expire_clear(spark):
    store = VerdictStore(spark, scratch_path(spark, "store"))
    assert tuple(store.stats().first()) == (0, None, None)
    result = '{"result":"phishing","confidence":1.0,"reasoning":["r"],"metadata":{"tier":3,"model":"m","tokens":100}}'
    old = result.replace("phishing", "safe")
    store.put(spark.createDataFrame([("k", old, 100.0)], VERDICT_CACHE))
    store.put(spark.createDataFrame([("k", result, 200.0)], VERDICT_CACHE))
    ask = spark.createDataFrame([(1, "k"), (2, "other")], "msg_id bigint, cache_key string")
    found = {r["msg_id"]: r["cached"] for r in store.lookup(ask, now=200.0).collect()}
    assert found[1]["result"] == "phishing" and found[1]["metadata"]["cache_hit"] and found[2] is None
    assert tuple(store.stats().first()) == (1, 200.0, 200.0)
    day = 24 * 3600
    assert store.lookup(ask, now=200.0 + day).filter("cached IS NOT NULL").count() == 1
    assert store.lookup(ask, now=200.1 + day).filter("cached IS NOT NULL").count() == 0
    store.compact()
    assert store.entries().count() == 1
    assert VerdictStore(spark, store.path).stats().first()["entry_count"] == 1
    store.clear()
    assert store.entries().count() == 0


def test_a_lookup_reads_the_parts_of_its_keys(spark):
    """Files read grow with the batch, and only entries of its keys are grouped."""
    store = VerdictStore(spark, scratch_path(spark, "store"))
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.lit("{}").alias("response_json"),
                                    F.lit(100.0).alias("created_at"))
    store.put(rows)
    store.put(rows.withColumn("created_at", F.lit(150.0)))
    for n in (0, 1, 5):
        keys = rows.limit(n).select("cache_key")
        near = store.entries_near(keys)
        files = near.select(F.col("_metadata.file_path").alias("f"), "key_part").distinct()
        parts = keys.select(C.key_part(F.col("cache_key"))).distinct().count()
        assert files.select("key_part").distinct().count() == parts <= n and files.count() <= 2 * parts
        assert [r["created_at"] for r in store.valid(keys, 150.0).collect()] == [150.0] * n
    assert "PartitionFilters: [isnotnull(key_part" in near._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters: [key_part" in near._jdf.queryExecution().executedPlan().toString()
    assert store.valid(spark.createDataFrame([(None,), ("none",)], "cache_key string"), 150.0).count() == 0
    assert store.valid(rows.select("cache_key"), 150.0).count() == 2000
    store.compact()
    assert store.entries().count() == 2000


def test_failed_calls_are_not_stored(spark):
    rows = [("a", "VERDICT: safe", 1, 2, "ok", None, 5), ("b", None, None, None, "rate_limited", "slow", 5)]
    df = spark.createDataFrame(rows, "cache_key string, response_text string, input_tokens int, output_tokens int, "
                                     "status string, error string, response_time_ms bigint")
    results = df.select("cache_key", E.expert_result("m").alias("tier3_result"))
    assert [r["cache_key"] for r in C.entries(results, 1.0).collect()] == ["a"]
    failed = results.filter("cache_key = 'b'").first()["tier3_result"]
    assert (failed["result"], failed["confidence"], failed["metadata"]["tokens"]) == ("phishing", 0.5, 0)
    assert failed["reasoning"] == [K.RATE_LIMITED_REASON] and failed["metadata"]["error"] == "slow"


def test_null_sessions_are_one_session(spark):
    rows = [(None, "A", 1), (None, "A", 2), (None, "B", 3), ("s", "A", 4)]
    df = spark.createDataFrame(rows, "session_id string, mail_id string, event_id int")
    df = df.withColumn("ts", F.timestamp_seconds("event_id"))
    assert [r["event_id"] for r in M.drop_repeats(df).orderBy("event_id").collect()] == [1, 3, 4]


def test_age_of_a_cache_entry(spark):
    """An entry of just the time to live is valid; the filter reaches the scan."""
    path = scratch_path(spark, "cache")
    now, ttl = I.NOW, 24
    rows = [("edge", "{}", now - ttl * 3600), ("old", "{}", now - ttl * 3600 - 1), ("new", "{}", now)]
    spark.createDataFrame(rows, "cache_key string, response_json string, created_at double").write.parquet(path)
    valid = C.fresh(spark.read.parquet(path), now, ttl)
    assert {r["cache_key"] for r in valid.collect()} == {"edge", "new"}
    assert "GreaterThanOrEqual(created_at" in valid._jdf.queryExecution().executedPlan().toString()


def test_every_message_has_an_outcome(spark):
    """A score out of range is refused with a reason, and the input is scanned once."""
    analyzer = _analyzer_with_given_scores()
    given = analyzer.url_detector

    class Broken:
        def score(self, df):
            r = F.col("tier1_result")
            bad = F.when(F.col("msg_id") == 2, r.withField("score", F.lit(float("nan")))).otherwise(r)
            return given.score(df).withColumn("tier1_result", bad)

    analyzer.url_detector = Broken()
    messages = spark.createDataFrame([(1, "http://a.b", "t", False), (2, "http://a.b", "t", False), (3, None, "", False)], MESSAGES)
    verdicts, rejects = analyzer.analyze_all(messages, now=1.0)
    assert [r["msg_id"] for r in verdicts.collect()] == [1]
    reasons = {r["msg_id"]: r["reject_reason"] for r in rejects.collect()}
    assert set(reasons) == {2, 3} == {r["msg_id"] for r in analyzer.rejects(messages).collect()}
    assert "NaN" in reasons[2] and "neither" in reasons[3]
    analyzer.drop_scratch()
    with pytest.raises(Exception):
        spark.read.parquet(*verdicts.inputFiles()).collect()


def test_mail_addresses_and_repeats(spark):
    rows = [("s1", "#inbox/A"), ("s1", "#inbox/A"), ("s1", "#inbox/B"), ("s1", "#sent/A"), ("s1", "#inbox/A"), ("s2", "#inbox/A")]
    df = spark.createDataFrame([(s, h, i) for i, (s, h) in enumerate(rows)], "session_id string, hash string, event_id int")
    # Half of the events in one hour and half in another.
    df = df.withColumn("ts", F.timestamp_seconds(F.col("event_id") * 1800))
    kept = M.drop_repeats(M.opened_mail(df)).orderBy("event_id").collect()
    assert [(r["session_id"], r["mail_id"]) for r in kept] == [("s1", "A"), ("s1", "B"), ("s1", "A"), ("s2", "A")]


def test_dashboard(spark):
    schema = "type string, payload struct<email: string, name: string, content: string>"
    df = spark.createDataFrame([("OPENED_EMAIL", (None, None, None)), ("OPENED_EMAIL", ("e", "", "c")), ("OTHER", ("x", "x", "x"))], schema)
    assert [tuple(r) for r in M.dashboard(M.only_opened(df)).collect()] == [("(unknown)", "(unknown)", ""), ("e", "", "c")]


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, label int")
    assert V.roc_auc(df).first()["auc"] == pytest.approx(0.875)
    assert V.roc_auc(df.filter("label = 1")).first()["auc"] is None


def test_strict_contract(spark):
    df = spark.createDataFrame([(0.5,), (1.5,)], "s double").withColumn("result", D.tier_result(F.col("s"), D.text_metadata(F.lit("x"))))
    assert V.require_valid_results(df.filter("s < 1")).count() == 1
    with pytest.raises(Exception, match="score out of range"):
        V.require_valid_results(df).collect()


def test_messages_end_to_end(spark):
    analyzer = _analyzer_with_given_scores()
    text, url = "Hello, this is a normal email.", "https://www.google.com"
    messages = spark.createDataFrame([(12, url, text, True), (13, None, "", False), (14, None, text, False)], MESSAGES)
    rows = {r["msg_id"]: r for r in analyzer.analyze(messages, now=1.0).collect()}
    assert set(rows) == {12, 14}
    assert rows[12]["tier_used"] == "3" and rows[12]["confidence"] == "high"
    assert rows[14]["details"]["tier1_result"] is None
    assert [r["msg_id"] for r in analyzer.rejects(messages).collect()] == [13]
    with pytest.raises(Exception, match="neither a url nor a text"):
        analyzer.analyze_one(spark)
    assert analyzer.analyze_one(spark, url=url, force_expert=True)["tier_used"] == "3"
    analyzer.make_expert = None
    with pytest.raises(ValueError, match="expert"):
        analyzer.analyze(messages, now=1.0)


def test_cache_options(spark):
    """A second message with the same key is a hit within its batch; skip_cache asks again but stores."""
    store = VerdictStore(spark, scratch_path(spark, "store"))
    analyzer = _analyzer_with_given_scores(store)
    text = "x" * 12
    messages = spark.createDataFrame([(1, None, text, True), (2, None, f" {text} ", True)], MESSAGES)

    def hits(**options):
        rows = analyzer.analyze(messages, now=I.NOW, **options).collect()
        return {r["msg_id"]: r["details"]["tier3_result"]["metadata"]["cache_hit"] for r in rows}

    assert hits() == {1: False, 2: True}
    assert hits() == {1: True, 2: True}
    assert hits(skip_cache=True) == {1: False, 2: False}
    assert store.entries().count() == 2 and store.stats().first()["entry_count"] == 1
