"""Class counts, balanced samples, stratified splits and folds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.operators.ranking import BUCKET_ROWS, assign_parts, hash_order, in_ranges, required


def class_distribution(df, label="label"):
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def hex_digits(n_rows, bucket_rows=BUCKET_ROWS):
    """Leading hash digits that cut ``n_rows`` into buckets of at most about ``bucket_rows``; three at least."""
    digits = 3
    while 16**digits * bucket_rows < n_rows:
        digits += 1
    return digits


def _by_hash(df, label, ids, seed, cuts, part):
    """``part`` by hash order inside each class. Rows without a label or an id fail the job."""
    digits = hex_digits(df.count())
    keyed = required(df, label, ids).withColumn("_order", hash_order(F.col(ids), seed))
    parted = assign_parts(keyed, label, ["_order", ids], F.substr("_order", F.lit(1), F.lit(digits)), cuts, part)
    return parted.drop("_order")


def balanced_sample(df, sample_size, label="label", ids="doc_id", seed=K.SEED):
    """At most ``sample_size // 2`` rows of each class, if there are more than ``sample_size`` rows at all."""
    if sample_size is None:
        return df

    def cuts(classes):
        total = F.sum("n").over(Window.partitionBy())
        keep = F.when(total > sample_size, F.lit(sample_size // 2).cast("bigint")).otherwise(F.col("n"))
        return classes.withColumn("cuts", F.array(keep))

    return _by_hash(df, label, ids, seed, cuts, "_part").filter(F.col("_part") == 0).drop("_part")


def stratified_split(df, label="label", ids="doc_id", test_fraction=K.TEST_FRACTION, seed=K.SEED):
    """Add ``is_test``. The test share is rounded up; classes keep their shares by largest remainder."""

    def cuts(classes):
        every = Window.partitionBy()
        total = F.sum("n").over(every)
        n_train = total - F.ceil(total * F.lit(float(test_fraction)))
        shared = classes.withColumn("_exact", n_train * F.col("n") / total).withColumn("_n_train", n_train)
        left_over = F.col("_n_train") - F.sum(F.floor("_exact")).over(every)
        by_remainder = Window.orderBy(F.desc(F.col("_exact") - F.floor("_exact")), F.col(label))
        train = F.floor("_exact") + (F.row_number().over(by_remainder) <= left_over).cast("int")
        return shared.withColumn("cuts", F.array((F.col("n") - train).cast("bigint")))

    parted = _by_hash(df, label, ids, seed, cuts, "_part")
    return parted.withColumn("is_test", F.col("_part") == 0).drop("_part")


def assign_folds(df, label="label", ids="doc_id", folds=K.N_FOLDS, part="fold"):
    """Add the fold number: stratified, unshuffled, contiguous inside each class in id order.

    Classes are laid end to end in the order of their first row; a class gives fold i as many rows as
    there are positions p in its stretch with ``p % folds == i``, which keeps all folds equally large. Rows
    without a label or an id fail the job.
    """
    df = in_ranges(required(df, label, ids), label, ids)
    first_rows = df.groupBy(label).agg(F.min(ids).alias("_first_id"))

    def cuts(classes):
        in_order = Window.orderBy("_first_id")
        placed = classes.join(first_rows, label).withColumn("_stop", F.sum("n").over(in_order))

        def positions(end, fold):
            return F.floor((end + F.lit(folds - 1 - fold)) / folds)

        sizes = [positions(F.col("_stop"), i) - positions(F.col("_stop") - F.col("n"), i) for i in range(folds)]
        return placed.withColumn("cuts", F.array(*[sum(sizes[1:i + 1], sizes[0]) for i in range(folds - 1)]))

    return assign_parts(df, label, [ids], F.col("_bucket"), cuts, part).drop("_bucket")
