"""Training tables from CSV, with the conventions of tabular-data readers."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch import constants as K
from lurewatch.operators.sampling import balanced_sample
from lurewatch.operators.texts import clean_text, require_columns
from lurewatch.operators.urls import url_features


def read_csv(spark, path, on_bad_lines="error", multi_line=True):
    """All columns as strings; cells such as ``NA`` are null.

    A line with surplus fields, also empty ones, fails the job, or is skipped with ``on_bad_lines="skip"``; a
    short line is filled with nulls. A file whose header differs from the others' fails the job. ``multi_line`` allows line breaks inside quotes but reads each file in one task:
    write many files, or switch it off for texts without line breaks, and files are split.
    """
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    fields = [T.StructField(n, T.StringType()) for n in [*names, "_record"]]
    # The header of every file is compared; all columns are parsed, so every odd line is seen.
    strict = {"enforceSchema": False, "columnPruning": False, "columnNameOfCorruptRecord": "_record"}
    raw = spark.read.options(**options, **strict).schema(T.StructType(fields)).csv(path)
    unquoted = F.regexp_replace("_record", r'"(?:[^"]|"")*+"', "")
    surplus = F.coalesce(F.length(F.regexp_replace(unquoted, "[^,]", "")) >= len(names), F.lit(False))
    if on_bad_lines == "skip":
        kept = raw.filter(~surplus)
    else:
        fail = F.raise_error(F.lit(f"a line of {path} has more fields than the header")).cast("boolean")
        kept = raw.filter(F.when(surplus, fail).otherwise(True))
    return kept.select(*[F.when(~F.col(n).isin(K.MISSING_CELLS), F.col(n)).alias(n) for n in names])


def as_label(name="label"):
    """An integer label; a missing or unreadable one fails the job."""
    missing = F.raise_error(F.lit("label is missing")).cast("int")
    return F.when(F.col(name).isNull(), missing).otherwise(F.col(name).cast("double").cast("int"))


def load_url_training(spark, path, suffixes=None, **csv):
    """(url, label, 18 features) of a url training file."""
    rows = require_columns(read_csv(spark, path, **csv), "url", "label").withColumn("label", as_label())
    return url_features(rows, "url", suffixes)


def prepare_text_training(df, sample_size=None, ids=None):
    """Clean rows with an integer label, balanced if asked for.

    ``ids`` names a unique column; without one, rows are identified by the hash of their content.
    """
    clean = clean_text(require_columns(df, "text", "label")).withColumn("label", as_label())
    if sample_size is None:
        return clean
    if ids is not None:
        return balanced_sample(clean, sample_size, ids=ids)
    keyed = clean.withColumn("_row", F.md5(F.to_json(F.struct(*clean.columns))))
    return balanced_sample(keyed, sample_size, ids="_row").drop("_row")


def load_text_training(spark, path, sample_size=None, ids=None, **csv):
    """Strict form: ``text`` and ``label`` must be there, and a malformed line fails the job."""
    return prepare_text_training(read_csv(spark, path, **csv), sample_size, ids)


def load_text_lenient(spark, path, sample_size=None, ids=None, **csv):
    """Lenient form: malformed lines are skipped, and ``message_body`` stands in for a missing ``text``."""
    rows = read_csv(spark, path, on_bad_lines="skip", **csv)
    if "text" not in rows.columns and "message_body" in rows.columns:
        rows = rows.withColumn("text", F.col("message_body"))
    return prepare_text_training(rows, sample_size, ids)


def write_csv(df, path):
    """A CSV that ``read_csv`` reads back unchanged."""
    df.write.options(
        header=True, quote='"', escape='"', quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
