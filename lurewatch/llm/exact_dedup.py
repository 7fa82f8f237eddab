"""Exact duplicates by content hash, with the bytes compared inside each hash group."""

from pyspark.sql import functions as F

from lurewatch.session import materialise

KEEP = {"smallest": F.min, "largest": F.max}


def _keyed(docs, text):
    content = F.coalesce(F.col(text), F.lit(""))
    return content, F.unhex(F.md5(content))


def text_classes(docs, ids="doc_id", text="text", keep="smallest"):
    """One row per distinct text: (_hash, _sha, keep_id, group_size), written to the shared folder.

    Rows are grouped by the 128-bit content hash, and inside a hash by the text itself, so the bytes are
    compared and two texts with one hash stay apart. Copies are folded before the shuffle, so a text that a
    third of all rows share reaches the reducer once per map task.
    """
    content, key = _keyed(docs, text)
    rows = docs.select(F.col(ids).alias("_id"), content.alias("_text"), key.alias("_hash"))
    classes = rows.groupBy("_hash", "_text").agg(
        KEEP[keep]("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return materialise(
        classes.select("_hash", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size"), "text-classes"
    )


def mark_exact_copies(docs, ids="doc_id", text="text", keep="smallest"):
    """One row per row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when all their bytes are; null counts as empty. Of equal texts the row with the smallest
    (or largest) id is kept. A null id never keeps others: its row is kept only if no copy has an id. Rows
    repeated with one id and one text are the same document and are marked alike. No rows, no result rows.
    Other columns of ``docs`` are not looked at.

    Rows find their class by both digests of the text (MD5 and SHA-256). Both sides of that join are plain
    tables, so Spark splits the partition of a text with very many copies.
    """
    content, key = _keyed(docs, text)
    rows = docs.select(F.col(ids).alias("doc_id"), key.alias("_hash"), F.sha2(content, 256).alias("_sha"))
    classes = text_classes(docs, ids, text, keep)
    return rows.join(classes, ["_hash", "_sha"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs, ids="doc_id", text="text", keep="smallest"):
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    A single aggregation: the whole row with the smallest (or largest) id of a text travels with it. Among
    rows with one id and one text, the one whose other columns sort last (first for "smallest") stays. A row
    with an id beats one without. Needs sortable columns.
    """
    content, key = _keyed(docs, text)
    others = [c for c in docs.columns if c != text]
    has_id = F.col(ids).isNotNull() if keep == "largest" else F.col(ids).isNull()
    picked = F.struct(has_id.alias("_h"), F.col(ids).alias("_i"),
                      F.struct(*[F.col(f"`{c}`") for c in others], F.col(text).isNull().alias("_null_text")).alias("_r"))
    best = docs.select(content.alias("_text"), key.alias("_hash"), picked.alias("_row")).groupBy(
        "_hash", "_text").agg(KEEP[keep]("_row").alias("_row"))
    return best.select(*[
        F.when(~F.col("_row._r._null_text"), F.col("_text")).alias(c) if c == text else F.col("_row._r")[c].alias(c)
        for c in docs.columns
    ])
