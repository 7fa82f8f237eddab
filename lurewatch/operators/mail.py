"""Opened-mail operators on batch tables; the streaming forms give the same rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import mail as M


def opened_mail(df, address_hash="hash"):
    """Add ``mail_id`` and keep the rows whose address is that of an opened mail."""
    return df.withColumn("mail_id", M.mail_id(F.col(address_hash))).filter(F.col("mail_id").isNotNull())


def drop_repeats(df, session="session_id", mail_id="mail_id", order=("ts", "event_id"), unit="hour", before=None):
    """Drop events that open the mail the same session had open just before: A, A, B, A gives A, B, A.

    A session may be very large, so it is cut into time buckets. The mail open at the end of the previous
    bucket comes from a table with one row per session and bucket. Choose ``unit`` so that no session has too
    many events in one. Null sessions are one session, as in the streaming form; null times come first.
    ``before`` is a table with the mail that sessions had open before all of these events, one row each.
    """
    order = list(order)
    bucketed = df.withColumn("_bucket", F.date_trunc(unit, F.col(order[0])))
    ends = bucketed.groupBy(session, "_bucket").agg(F.max_by(mail_id, F.struct(*order)).alias("_end"))
    over_buckets = Window.partitionBy(session).orderBy("_bucket")
    carried = ends.withColumn("_carried", F.lag("_end").over(over_buckets))
    if before is not None:
        known = before.select(F.col(session).alias("_known"), F.col(mail_id).alias("_before"))
        first = F.row_number().over(over_buckets) == 1
        carried = carried.withColumn("_first", first).join(known, F.col(session).eqNullSafe(F.col("_known")), "left")
        carried = carried.withColumn("_carried", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_carried")))
    carried = carried.select(session, "_bucket", "_carried")
    inside = Window.partitionBy(session, "_bucket").orderBy(*order)
    previous = F.coalesce(F.col("_previous"), F.col("_carried"))
    return (
        bucketed.withColumn("_previous", F.lag(mail_id).over(inside))
        .join(
            carried.withColumnsRenamed({session: "_session", "_bucket": "_at"}),
            F.col(session).eqNullSafe(F.col("_session")) & F.col("_bucket").eqNullSafe(F.col("_at")),
        )
        .filter(~F.col(mail_id).eqNullSafe(previous))
        .select(*df.columns)
    )


def open_at_end(df, session="session_id", mail_id="mail_id", order=("ts", "event_id")):
    """The mail that each session has open after its last event; partial maxima before the shuffle."""
    return df.groupBy(session).agg(F.max_by(mail_id, F.struct(*order)).alias(mail_id))


def with_payload(df, email="email", name="name", content="content"):
    """Fold sender and content into ``payload`` and set the message type."""
    payload = F.struct(
        F.col(email).alias("email"), F.col(name).alias("name"), F.col(content).alias("content")
    )
    rest = [c for c in df.columns if c not in (email, name, content, "type")]
    return df.select(F.lit(K.OPENED_EMAIL).alias("type"), payload.alias("payload"), *rest)


def only_opened(df):
    """Keep opened-mail messages; other message types are ignored."""
    return df.filter(F.col("type") == K.OPENED_EMAIL)


def dashboard(df):
    """(email, name, content) as listed: placeholders for what is missing, empty text kept."""
    p = F.col("payload")
    rest = [c for c in df.columns if c not in ("type", "payload")]
    return df.select(
        *rest,
        F.coalesce(p["email"], F.lit(K.UNKNOWN_SENDER)).alias("email"),
        F.coalesce(p["name"], F.lit(K.UNKNOWN_SENDER)).alias("name"),
        F.coalesce(p["content"], F.lit("")).alias("content"),
    )


def as_messages(df, ids="event_id"):
    """Captured mail as messages to score: the content is the text, its first web address the url."""
    content = F.col("payload")["content"]
    return df.select(
        F.col(ids).cast("bigint").alias("msg_id"),
        M.first_url(content).alias("url"),
        content.alias("text"),
        F.lit(False).alias("force_expert"),
    )
