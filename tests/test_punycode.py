"""Punycode labels against Python's codec, and hosts and rules in either form."""

import random

import pytest
from pyspark.sql import functions as F

from lurewatch.functions import punycode as P
from lurewatch.operators.urls import with_host_parts

LETTERS = "abcxyz019-\u00e9\u00fc\u00df\u0436\u044f\u3042\u6f22\u5b57\U0001f600\ud55c\u0301"


def decoded(spark, labels):
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    return [r["d"] for r in df.select(P.decoded_label(F.col("x")).alias("d")).collect()]


def test_labels_like_the_codec(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices(LETTERS, k=rng.randint(1, 20))) for _ in range(400)]
    words += ["m\u00fcnchen", "a" * 50 + "\u00e9", "\U0010ffff" * 3, "\u00e9" * 60, "\u0080"]
    words = [w for w in words if not w.isascii()]
    assert decoded(spark, ["xn--" + w.encode("punycode").decode() for w in words]) == words


@pytest.mark.parametrize("label", ["xn--", "xn---", "xn--a-", "xn--zzzzzzzzzzzzzz", "xn--" + "9" * 30, "xn--0",
                                   "xn--\u00e9", "xn--a_b", "com", "", None])
def test_what_is_no_punycode_stays(spark, label):
    assert decoded(spark, [label]) == [label]


@pytest.mark.parametrize("rule", ["\u0440\u0444", "xn--p1ai"])
@pytest.mark.parametrize("as_table", [False, True])
def test_hosts_meet_rules_in_either_form(spark, rule, as_table):
    hosts = ["http://a.example.xn--p1ai/x", "http://a.example.\u0440\u0444", "http://b.XN--P1AI", "http://xn--p1ai", "http://a.b.com", None]
    rules = spark.createDataFrame([(rule,), ("com",)], "r string") if as_table else [rule, "com"]
    df = spark.createDataFrame(list(enumerate(hosts)), "i int, url string")
    found = {r["i"]: r["p"] and tuple(r["p"]) for r in with_host_parts(df, suffixes=rules).select("i", F.col("host_parts").alias("p")).collect()}
    assert found == {0: ("a", "example", "xn--p1ai"), 1: ("a", "example", "\u0440\u0444"), 2: ("", "b", "XN--P1AI"),
                     3: ("", "", "xn--p1ai"), 4: ("a", "b", "com"), 5: None}
