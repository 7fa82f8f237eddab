"""Url operators: splitting, host parts and the feature table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import punycode as P
from lurewatch.functions import urls as U
from lurewatch.session import materialise


def split_urls(df, url="url"):
    """Add ``scheme``, ``netloc`` and ``path``."""
    return (
        df.withColumn("_parts", U.url_parts(F.col(url)))
        .select("*", "_parts.scheme", "_parts.netloc", "_parts.path")
        .drop("_parts")
    )


def suffix_rules(suffixes):
    """Rules from a list; None for a one-column table, whose rules are joined whatever their number."""
    if suffixes is None:
        return U.SuffixRules()
    if isinstance(suffixes, U.SuffixRules):
        return suffixes
    if isinstance(suffixes, DataFrame):
        return None
    return U.SuffixRules(suffixes)


def with_host_parts(df, url="url", suffixes=None):
    """Add the struct ``host_parts`` (subdomain, domain, suffix).

    ``suffixes`` is a list of rules, a one-column table of rules, or None for the default list. A list becomes
    literals of a projection; a table is joined. A null url has no parts.
    """
    rules = suffix_rules(suffixes)
    hosted = df.withColumn("_host", U.lenient_host(F.col(url)))
    if rules is None:
        hosted = _join_suffix_labels(hosted, suffixes)
    else:
        hosted = hosted.withColumn("_rule_host", U.rule_host(F.col("_host")))
        hosted = hosted.withColumn("_suffix_labels", rules.suffix_labels(F.col("_rule_host"))).drop("_rule_host")
    parts = F.when(F.col(url).isNotNull(), U.split_host(F.col("_host"), F.col("_suffix_labels")))
    return hosted.withColumn("host_parts", parts).drop(
        "_host", "_suffix_labels"
    )


def _join_suffix_labels(df, rule_table):
    """Suffix lengths by a join of the different hosts with a rule table of any size.

    Very many hosts end alike ("com"). Both sides of that join are plain rows, so Spark splits such a partition;
    a rule that is listed twice changes no maximum.
    """
    rule = P.unicode_host(F.lower(F.trim(F.col(rule_table.columns[0]))))
    wild, exception = F.startswith(rule, F.lit("*.")), F.startswith(rule, F.lit("!"))
    rules = rule_table.select(
        F.when(wild, F.substr(rule, F.lit(3))).when(exception, F.substr(rule, F.lit(2))).otherwise(rule).alias("tail"),
        F.when(wild, 1).when(exception, -1).otherwise(0).alias("extra"),
    )
    hosts = df.select("_host").distinct().withColumn("_rule_host", U.rule_host(F.col("_host")))
    labels = F.size(F.split("_rule_host", r"\."))
    tails = hosts.select(
        "_host", "_rule_host", labels.alias("n"), F.explode(F.sequence(F.lit(1), labels)).alias("k")
    ).withColumn("tail", F.call_function("substring_index", F.col("_rule_host"), F.lit("."), -F.col("k")))
    lengths = (
        tails.join(rules, "tail")
        .filter(F.col("k") + F.col("extra") <= F.col("n"))
        .groupBy("_host")
        .agg(
            F.max(F.when(F.col("extra") < 0, F.col("k") - 1)).alias("by_exception"),
            F.max(F.col("k") + F.greatest("extra", F.lit(0))).alias("by_rule"),
        )
        .select("_host", F.coalesce("by_exception", "by_rule").alias("_suffix_labels"))
    )
    return df.join(materialise(lengths, "suffix-lengths"), "_host", "left").withColumn("_suffix_labels", F.coalesce("_suffix_labels", F.lit(0)))


def url_features(df, url="url", suffixes=None):
    """Add the 18 feature columns; a missing, empty or malformed url has all features 0."""
    known = F.coalesce(F.col(url), F.lit(""))
    base = df.withColumn("_url", known).withColumn("_parts", U.url_parts(F.col("_url")))
    base = with_host_parts(base, "_url", suffixes).withColumn(
        "_usable", (F.col("_url") != "") & ~U.is_malformed(F.col("_parts")["netloc"])
    )
    features = U.feature_columns(F.col("_url"), F.col("_parts"), F.col("host_parts"))
    zero = {name: F.lit(0.0 if name in K.ENTROPY_FEATURES else 0) for name in features}
    return base.select(
        *[F.col(c) for c in df.columns],
        *[F.when(F.col("_usable"), col).otherwise(zero[name]).alias(name) for name, col in features.items()],
    )
