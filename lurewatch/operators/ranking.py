"""Exact ranks inside large classes without sorting a class in one task.

Rows are put into order-preserving buckets. Counts per (class, bucket) are a small table; their running
sums tell for almost every bucket on which side of a cut all of its rows lie. Only rows of the few buckets
that a cut goes through are ranked. The number of buckets follows the number of rows, so none grows with it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.session import materialise

#: Rows of a bucket on average; buckets grow in number with the table.
BUCKET_ROWS = 50_000


def required(df, *names):
    """``df`` whose named columns fail the job where they are null: such rows have no rank."""
    def checked(name):
        missing = F.raise_error(F.lit(f"{name} is missing")).cast(df.schema[name].dataType)
        return F.when(F.col(name).isNull(), missing).otherwise(F.col(name))

    return df.withColumns({name: checked(name) for name in names})


def hash_order(ids, seed=K.SEED):
    """A reproducible random order: MD5 of the seed and the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), ids.cast("string")))


def assign_parts(df, label, order, bucket, cuts, part="part"):
    """Add ``part``: how many cut positions lie at or below the row's 0-based rank inside its class.

    ``order`` lists the columns of the total order inside a class, ``bucket`` is a column that never
    decreases along it, and ``cuts(classes)`` turns the table (label, n, first) of the classes into
    (label, cuts array<bigint>); ``first`` is the smallest bucket value of the class.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))

    classes = counts.groupBy(label).agg(F.sum("_n").alias("n"))
    along = Window.partitionBy(label).orderBy("_bucket")
    before = F.sum("_n").over(along) - F.col("_n")
    placed = (
        counts.withColumn("_before", before)
        .join(cuts(classes).select(label, "cuts"), label)
        .withColumn("_first", parts_below("cuts", F.col("_before")))
        .withColumn("_last", parts_below("cuts", F.col("_before") + F.col("_n") - 1))
        .drop("_n")
    )

    rows = keyed.join(placed, [label, "_bucket"])
    whole = rows.filter(F.col("_first") == F.col("_last")).withColumn(part, F.col("_first"))
    inside = Window.partitionBy(label, "_bucket").orderBy(*order)
    cut = rows.filter(F.col("_first") != F.col("_last")).withColumn(
        part, parts_below("cuts", F.col("_before") + F.row_number().over(inside) - 1)
    )
    return whole.unionByName(cut).select(*df.columns, part)


def parts_below(cuts, rank):
    return F.size(F.filter(F.col(cuts), lambda c: c <= rank))


def in_ranges(df, *order):
    """``df`` with ``_bucket``, which never decreases along ``order``, in buckets of about ``BUCKET_ROWS`` rows.

    Sorted ranges of the whole table, as many as its size asks for. Bounds are sampled, so the result is
    written once and read again: later steps all see the same buckets.
    """
    rows = materialise(df, "unranged")
    parallel = df.sparkSession.sparkContext.defaultParallelism
    n = max(parallel, -(-rows.count() // BUCKET_ROWS))
    return materialise(rows.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id()), "ranged")
