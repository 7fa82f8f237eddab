"""Url features against golden rows and against Python's own url splitter on random strings."""

import math
from collections import Counter
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import strings as S
from lurewatch.operators.urls import split_urls, url_features, with_host_parts

GOLDEN = {
    "https://secure-paypal-verify.tk/login":
        (37, 20, 6, 1, 2, 0, 3, 0, 0, 4.317033, 3.584184, 0, 4, 0, 1, 0, 0, 0),
    "https://www.google.com": (22, 6, 0, 2, 0, 0, 2, 0, 0, 3.663533, 1.918296, 0, 0, 0, 1, 0, 1, 0),
    "https://example.com/verify": (26, 7, 7, 1, 0, 0, 3, 0, 0, 4.10391, 2.521641, 0, 1, 0, 1, 0, 0, 0),
    "http://fake-bank.tk": (19, 9, 0, 1, 1, 0, 2, 0, 0, 3.536887, 2.725481, 0, 0, 1, 0, 0, 0, 0),
    "http://1.2.3.4:8080/a": (21, 7, 2, 3, 0, 0, 3, 0, 8, 3.558519, 2.128085, 1, 0, 0, 0, 0, 0, 1),
    "http://1.2.3.4.evil.com:80/x": (28, 4, 2, 5, 0, 0, 3, 0, 6, 4.08005, 2.0, 1, 0, 0, 0, 0, 4, 0),
    "http://user:pw@host.co.uk/p;x=1?q#f": (35, 4, 2, 2, 0, 0, 3, 1, 1, 4.378864, 2.0, 0, 0, 0, 0, 1, 0, 0),
    "example.com/verify": (18, 7, 18, 1, 0, 0, 1, 0, 0, 3.794653, 2.521641, 0, 1, 0, 0, 0, 0, 0),
    "http://login.login.account-update.top":
        (37, 14, 0, 3, 1, 0, 2, 0, 0, 3.915553, 3.235926, 0, 3, 1, 0, 0, 2, 0),
    "HTTPS://A.B.EX4MPLE.COM:8443/_x-y": (33, 7, 5, 3, 1, 1, 3, 0, 5, 4.309101, 2.521641, 0, 0, 0, 1, 1, 2, 1),
    None: (0,) * 18,
    "": (0,) * 18,
    "http://[bad/x": (0,) * 18,
}


def test_golden_features(spark):
    df = spark.createDataFrame([(u,) for u in GOLDEN], "url string")
    for row in url_features(df).collect():
        assert tuple(round(row[n], 6) for n in K.URL_FEATURES) == GOLDEN[row["url"]], row["url"]


def test_features_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(u,) for u in GOLDEN], "url string")
    a = sorted(map(repr, url_features(df.repartition(1)).collect()))
    assert a == sorted(map(repr, url_features(df.repartition(7)).collect()))


def test_plan_is_one_stage(spark):
    plan = url_features(spark.createDataFrame([("http://a.b",)], "url string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


urls = st.text(st.sampled_from("ab:/?#[]@;.-_1٣²\t \n%ÉxhttpsHTTPS"), max_size=25)
urls = st.one_of(urls, urls.map("http://".__add__), urls.map("HTTPS://h/".__add__), st.text(max_size=15))


def python_split(url):
    try:
        p = urlparse(url)
    except ValueError:
        return None
    return p.scheme, p.netloc, p.path


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(urls.filter(lambda u: u and not any(0xD800 <= ord(c) < 0xE000 for c in u)),
                min_size=250, max_size=250))
def test_split_like_python(spark, batch):
    df = spark.createDataFrame([(u,) for u in batch], "url string")
    for row in url_features(split_urls(df)).collect():
        expected = python_split(row["url"])
        if expected is None:
            assert row["url_length"] == 0
            continue
        assert (row["scheme"], row["netloc"], row["path"]) == expected, row["url"]
        url, n = row["url"], len(row["url"])
        assert row["url_length"] == n
        assert row["num_digits"] == sum(c.isdigit() for c in url)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
        assert row["url_entropy"] == pytest.approx(entropy, abs=1e-9)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=12).filter(lambda u: not any(0xD800 <= ord(c) < 0xE000 for c in u)),
                min_size=250, max_size=250))
def test_strip_and_accents_like_python(spark, batch):
    import unicodedata

    spaced = [" 　" + t + "\x1f\n" for t in batch] + batch + ["Ça ﬁ ½ 한국어 ²É ß œ"]
    df = spark.createDataFrame([(t,) for t in spaced], "t string")
    for row in df.select("t", S.strip(F.col("t")).alias("s"), S.strip_accents(F.col("t")).alias("a")).collect():
        assert row["s"] == row["t"].strip()
        plain = unicodedata.normalize("NFKD", row["t"])
        assert row["a"] == "".join(c for c in plain if not unicodedata.combining(c))


def test_joined_rules_agree_with_literal_rules(spark):
    hosts = ["a.b.www.ck", "x.foo.ck", "foo.ck", "ck", "co.uk", "a.city.kawasaki.jp", "b.c.kawasaki.jp", "q", "",
             "1.2.3.4", "[::1]", "A.B.CO.UK.", "u:p@h.example.com:80", "nope.unknown"]
    df = spark.createDataFrame([(f"http://{h}/p",) for h in hosts], "url string")
    rules = spark.createDataFrame([(r,) for r in K.DEFAULT_SUFFIXES], "rule string")
    literal = {r["url"]: r["host_parts"] for r in with_host_parts(df).collect()}
    joined = {r["url"]: r["host_parts"] for r in with_host_parts(df, suffixes=rules).collect()}
    assert literal == joined
    assert literal["http://a.city.kawasaki.jp/p"]["suffix"] == "kawasaki.jp"
    assert literal["http://b.c.kawasaki.jp/p"]["suffix"] == "c.kawasaki.jp"
    assert literal["http://co.uk/p"]["domain"] == ""
