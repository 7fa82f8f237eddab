"""Columns around the expert: cache key, prompt, parsed verdict and reasons, result struct."""

from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import strings as S


def cache_key(url, text):
    """MD5 of the lower-cased, stripped url and the stripped text; a missing part counts as empty."""
    url, text = F.coalesce(url, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(S.strip(F.lower(url)), F.lit("||"), S.strip(text)))


def prompt(url, text):
    return F.concat(
        F.lit(K.PROMPT_HEAD), F.coalesce(url, F.lit("")), F.lit(K.PROMPT_MIDDLE),
        F.left(F.coalesce(text, F.lit("")), F.lit(K.PROMPT_TEXT_CHARS)), F.lit(K.PROMPT_TAIL),
    )


def verdict(response):
    """The first stated verdict; a response without one counts as phishing."""
    stated = F.regexp_extract(response, rf"(?iu)VERDICT:[{S.space_class()}]*(phishing|safe)", 1)
    return F.coalesce(F.nullif(F.lower(stated), F.lit("")), F.lit(K.PHISHING))


def reasons(response):
    """At most three points of the reasoning section; one standard sentence if there is none."""
    space = S.space_class()
    section = F.regexp_extract(response, rf"(?isu)REASONING:[{space}]*(.*)", 1)
    # (?d): a point ends at a line feed and at no other line break.
    points = F.regexp_extract_all(section, F.lit(rf"(?d)-[{space}]*(.+)"), F.lit(1))
    first = F.transform(F.slice(points, 1, K.MAX_REASONS), S.strip)
    return F.when(F.size(first) > 0, first).otherwise(F.array(F.lit(K.NO_REASON)))


def expert_result(model, response="response_text"):
    """Result struct of a response row; failed calls give a cautious standard verdict."""
    text, status = F.col(response), F.col("status")
    ok = status == "ok"
    apology = F.when(status == "rate_limited", K.RATE_LIMITED_REASON).otherwise(F.lit(K.API_ERROR_REASON))
    return F.struct(
        F.when(ok, verdict(text)).otherwise(K.PHISHING).alias("result"),
        F.when(ok, 1.0).otherwise(K.FALLBACK_CONFIDENCE).alias("confidence"),
        F.when(ok, reasons(text)).otherwise(F.array(apology)).alias("reasoning"),
        F.struct(
            F.lit(3).alias("tier"),
            F.lit(model).alias("model"),
            F.when(ok, F.col("input_tokens") + F.col("output_tokens")).otherwise(0).cast("int").alias("tokens"),
            F.lit(False).alias("cache_hit"),
            F.col("response_time_ms").cast("bigint").alias("response_time_ms"),
            F.when(~ok, F.coalesce(F.col("error"), status)).alias("error"),
        ).alias("metadata"),
    )


def expert_risk(result):
    return F.when(result == K.PHISHING, "High").otherwise("Low")
