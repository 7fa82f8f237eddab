"""Inputs of the registered queries, derived from the given tables.

The expressions are plain SQL that Spark and DuckDB read alike, so both sides of a check start from the
same rows; what is checked is computed separately.
"""

from pyspark.sql import functions as F

from lurewatch.session import input_partitions

NOW = 1_700_000_000.0

# Eleven forms of every page url: as it is, and with the peculiarities that the features look at.
URL_FORMS = r"""
CASE form
  WHEN 0 THEN url
  WHEN 1 THEN 'http://' || CAST(page_id % 256 AS STRING) || '.0.113.7:8080/' || CAST(page_id AS STRING) || '/login'
  WHEN 2 THEN replace(regexp_replace(url, '^https?', 'HTTPS'), 'example', 'Secure-PayPal.account-update') || '_x'
  WHEN 3 THEN regexp_replace(url, '^https?://', '')
  WHEN 4 THEN 'http://user:pw@' || regexp_replace(url, '^https?://', '') || ';v=1/a;b=2?q=1#f'
  WHEN 5 THEN upper(url) || '.TOP'
  WHEN 6 THEN regexp_replace(url, '^(https?://)', '\1[')
  WHEN 7 THEN replace(url, '.example.com', '.shop4you.co.uk:8443') || '²٣é'
  WHEN 8 THEN 'http://10.20.30.40.' || regexp_replace(url, '^https?://', '')
  WHEN 9 THEN '  http://[::1]:' || CAST(page_id AS STRING) || '/confirm?x=' || url
  ELSE CASE WHEN page_id % 2 = 0 THEN '' END
END
"""

# Tier scores that hit the cut-offs exactly; null where a tier did not run.
SCORE1 = "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST((id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END"
SCORE2 = "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST((id * 61) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END"

# The same with scores out of range.
BAD_SCORE1 = f"CASE WHEN id % 13 = 0 THEN CAST(1.25 AS DOUBLE) ELSE {SCORE1} END"
BAD_SCORE2 = f"CASE WHEN id % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE {SCORE2} END"

# Labels that go along with the scores, with errors on both sides.
LABEL = "CASE WHEN ((id * 37) % 101) + ((id * 29) % 41) > 70 THEN 1 ELSE 0 END"
LOGIT0 = "CAST((id * 37) % 101 AS DOUBLE) / CAST(10 AS DOUBLE) - 5"
LOGIT1 = "CAST((id * 61) % 101 AS DOUBLE) / CAST(10 AS DOUBLE) - 5"

# Expert answers around the whole text of a document, in the shapes a parser meets.
RESPONSE = r"""
CASE doc_id % 6
  WHEN 0 THEN 'VERDICT: safe' || chr(10) || 'REASONING:' || chr(10) || '- ' || replace(text, '. ', '.' || chr(10) || '- ')
  WHEN 1 THEN 'verdict:' || chr(10) || ' PHISHING' || chr(10) || 'Reasoning: ' || replace(text, ', ', chr(10) || '-  ')
  WHEN 2 THEN 'VERDICT: [phishing]' || chr(10) || 'REASONING:' || chr(10) || 'This is well-known' || chr(10) || '-one' || chr(10) || '- ' || text
  WHEN 3 THEN text
  WHEN 4 THEN text || chr(10) || 'VERDICT: safe' || chr(10) || 'VERDICT: phishing'
  ELSE 'REASONING: - ' || text || chr(13) || chr(10) || '-  '
END
"""
STATUS = "CASE WHEN doc_id % 19 = 0 THEN 'rate_limited' WHEN doc_id % 23 = 0 THEN 'api_error' ELSE 'ok' END"

MAIL_HASH = """
(CASE WHEN event_id % 10 = 0 THEN '#sent/' ELSE '#inbox/' END) || event_type
|| (CASE WHEN event_id % 3 = 0 THEN '/top' ELSE '' END)
"""
MAIL_TYPE = "CASE WHEN event_id % 9 = 0 THEN 'CLOSED_EMAIL' ELSE 'OPENED_EMAIL' END"
MAIL_EMAIL = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'u' || CAST(user_id AS STRING) || '@example.com' END"
MAIL_NAME = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE 'User ' || CAST(user_id AS STRING) END"
MAIL_CONTENT = "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'see https://example.com/' || event_type || ' ' || props END"


TEXT_TABLES = ("documents", "pages")


def table(spark, sf, name):
    """A given table; those whose rows are costly to work on are dealt out as the session asks."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return input_partitions(df) if name in TEXT_TABLES else df


def url_forms(spark, sf):
    """(page_id, form, url)."""
    forms = F.explode(F.sequence(F.lit(0), F.lit(10))).alias("form")
    pages = table(spark, sf, "pages").select("page_id", "url", forms)
    # Spark writes a group reference with a dollar sign.
    return pages.withColumn("url", F.expr("CAST(" + URL_FORMS.replace(r"\1", "$1") + " AS STRING)"))


def labelled_documents(spark, sf):
    """(doc_id, text, label)."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    return table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id")


def labelled_urls(spark, sf):
    """(page_id, url, label): hosts that advertise pills or spam count as phishing."""
    spam = F.col("url").contains("spam-farm") | F.col("url").contains("cheap-pills")
    return table(spark, sf, "pages").select("page_id", "url", spam.cast("int").alias("label"))


def messages(spark, sf):
    """(msg_id, url, text, force_expert): documents, some with the url of a page, some without a text."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    d = table(spark, sf, "documents").select("doc_id", "text").join(pages, "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("msg_id"),
        F.expr("CASE WHEN doc_id % 10 = 9 THEN '' ELSE url END").alias("url"),
        F.expr("CASE WHEN doc_id % 10 = 8 THEN '' WHEN doc_id % 10 = 9 THEN NULL ELSE text END").alias("text"),
        F.expr("doc_id % 14 = 1").alias("force_expert"),
    )


MESSAGES_SQL = """
messages AS (
  SELECT doc_id AS msg_id,
         CASE WHEN doc_id % 10 = 9 THEN '' ELSE url END AS url,
         CASE WHEN doc_id % 10 = 8 THEN '' WHEN doc_id % 10 = 9 THEN NULL ELSE text END AS text,
         doc_id % 14 = 1 AS force_expert
  FROM documents LEFT JOIN (SELECT page_id AS doc_id, url FROM pages) USING (doc_id))
"""


def line_scores(spark, sf):
    """(id, score, label, prediction) for every line item."""
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return lines.select(
        "id", F.expr(SCORE1).alias("s"), F.expr(LABEL).alias("label")
    ).select("id", F.coalesce("s", F.lit(0.5)).alias("score"), "label").withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int")
    )


LINE_SCORES_SQL = f"""
lines AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id FROM lineitem),
scored AS (SELECT id, coalesce({SCORE1}, 0.5::DOUBLE) AS score, {LABEL} AS label FROM lines),
predicted AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored)
"""


def order_scores(spark, sf, score1=SCORE1, score2=SCORE2):
    """(id, tier1_score, tier2_score) for every order."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"))
    return orders.select("id", F.expr(score1).alias("tier1_score"), F.expr(score2).alias("tier2_score"))


def order_scores_sql(score1=SCORE1, score2=SCORE2):
    return f"""
orders_ids AS (SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders),
tiers AS (SELECT id, {score1} AS tier1_score, {score2} AS tier2_score FROM orders_ids)
"""


def responses(spark, sf):
    """Expert response rows, one per document."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.expr(RESPONSE).alias("response_text"),
        F.expr("CAST(n_chars AS INT)").alias("input_tokens"),
        F.expr("CAST(doc_id % 100 AS INT)").alias("output_tokens"),
        F.expr(STATUS).alias("status"),
        F.expr(f"CASE WHEN ({STATUS}) <> 'ok' THEN 'code ' || CAST(doc_id AS STRING) END").alias("error"),
        F.expr("CAST(doc_id % 7 AS BIGINT)").alias("response_time_ms"),
    )


def mail_events(events):
    """Mail events from the events table, static or streaming."""
    return events.select(
        F.expr(MAIL_TYPE).alias("type"),
        F.expr(MAIL_EMAIL).alias("email"),
        F.expr(MAIL_NAME).alias("name"),
        F.expr(MAIL_CONTENT).alias("content"),
        F.col("user_id").cast("string").alias("session_id"),
        F.expr(MAIL_HASH).alias("hash"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


MAIL_SQL = f"""
mail AS (
  SELECT {MAIL_TYPE} AS type, {MAIL_EMAIL} AS email, {MAIL_NAME} AS name, {MAIL_CONTENT} AS content,
         CAST(user_id AS VARCHAR) AS session_id, {MAIL_HASH} AS hash, ts, event_id
  FROM events)
"""


def make_expert():
    """A deterministic expert: its answer depends on the lengths of url and text only."""

    def answer(batch):
        import pandas as pd

        n, m = batch["text"].str.len(), batch["url"].str.len()
        verdict = n.mod(3).eq(0).map({True: "safe", False: "phishing"})
        text = "VERDICT: " + verdict + "\nREASONING:\n- text of " + n.astype(str) + " characters\n- url of "
        text = text + m.astype(str) + " characters\n- third point\n- fourth point"
        status = n.mod(11).map(lambda r: "rate_limited" if r == 0 else "api_error" if r == 5 else "ok")
        error = status.map({"rate_limited": "slow down", "api_error": "broken"})
        error = error.where(status.ne("ok"), None)
        return pd.DataFrame(
            {"response_text": text, "input_tokens": n.astype("int32"), "output_tokens": m.astype("int32"),
             "status": status, "error": error}
        )

    return answer


# What that expert says, as SQL over url and text.
EXPERT_SQL = """
expert AS (
  SELECT *, length(coalesce(text, '')) AS n, length(coalesce(url, '')) AS m,
         CASE WHEN n % 11 = 0 THEN 'rate_limited' WHEN n % 11 = 5 THEN 'api_error' ELSE 'ok' END AS status,
         CASE WHEN status <> 'ok' THEN 'phishing' WHEN n % 3 = 0 THEN 'safe' ELSE 'phishing' END AS verdict,
         CASE WHEN status = 'rate_limited' THEN 'Rate limited - defaulting to cautious assessment'
              WHEN status = 'api_error' THEN 'API error - defaulting to cautious assessment'
              ELSE 'text of ' || n || ' characters|url of ' || m || ' characters|third point' END AS points
  FROM queue)
"""
