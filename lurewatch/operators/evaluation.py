"""Evaluation aggregates: each is one pass of map-side sums over the scored rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.operators.ranking import in_ranges, required


def confusion_matrix(df, label="label", prediction="prediction"):
    """(tn, fp, fn, tp) with class 1 as the positive class."""
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(
        F.count_if(~actual & ~predicted).alias("tn"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(actual & predicted).alias("tp"),
    )


def _ratio(part, whole):
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(precision, recall):
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(df, label="label", prediction="prediction"):
    """(accuracy, precision, recall, f1) of the positive class; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return confusion_matrix(df, label, prediction).select(
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )


def classification_report(df, label="label", prediction="prediction", names=("Benign", "Phishing")):
    """(row, precision, recall, f1, support) for each class, the accuracy, and both averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp

    def scores(hits, false_hits, misses):
        precision, recall = _ratio(hits, hits + false_hits), _ratio(hits, hits + misses)
        return [precision, recall, _f1(precision, recall)], hits + misses

    negative, n_negative = scores(tn, fn, fp)
    positive, n_positive = scores(tp, fp, fn)
    macro = [(a + b) / 2 for a, b in zip(negative, positive)]
    weighted = [_ratio(a * n_negative + b * n_positive, total) for a, b in zip(negative, positive)]
    accuracy = _ratio(tp + tn, total)

    def row(name, values, support):
        columns = [F.lit(name).alias("row")]
        columns += [v.alias(n) for v, n in zip(values, ("precision", "recall", "f1"))]
        return F.struct(*columns, support.cast("bigint").alias("support"))

    rows = [
        row(names[0], negative, n_negative),
        row(names[1], positive, n_positive),
        row("accuracy", [accuracy] * 3, total),
        row("macro avg", macro, total),
        row("weighted avg", weighted, total),
    ]
    return confusion_matrix(df, label, prediction).select(F.inline(F.array(*rows)))


def roc_auc(df, score="score", label="label", by=()):
    """Exact area under the ROC curve, ties at mid-rank, for all rows or per group in ``by``.

    Rows collapse to distinct scores first. Those go to sorted ranges, so running counts need no single sorted
    task: a range's rows are ordered inside it, and the totals of earlier ranges come from a small table. The
    ranges only balance the work; the result is exact. A null score or label fails the job.
    """
    by = list(by)
    df = required(df, score, label)
    distinct = df.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    bucketed = in_ranges(distinct, *by, score)

    # Pairs won inside a bucket, plus the bucket's totals.
    earlier = Window.partitionBy(*by, "_bucket").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(earlier), F.lit(0))
    buckets = (
        bucketed.withColumn("_won", F.col("_pos") * (below + F.col("_neg") / F.lit(2.0)))
        .groupBy(*by, "_bucket")
        .agg(*[F.sum(c).alias(c) for c in ("_won", "_pos", "_neg")])
    )
    # Pairs won across buckets, of which there is one row per range.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    neg_before = F.coalesce(F.sum("_neg").over(before), F.lit(0))
    totals = (
        buckets.withColumn("_won", F.col("_won") + F.col("_pos") * neg_before)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in ("_won", "_pos", "_neg")])
    )
    pairs = F.col("_pos").cast("double") * F.col("_neg")
    return totals.select(*by, F.try_divide("_won", pairs).alias("auc"))


def accuracy_gate(df, expected="expected", actual="label", needed=K.ACCURACY_GATE):
    """(correct, total, passed): labelled cases, and whether enough of them are right."""
    correct = F.count_if(F.col(expected) == F.col(actual))
    return df.agg(
        correct.alias("correct"),
        F.count(F.lit(1)).alias("total"),
        (correct >= needed).alias("passed"),
    )


def misclassified(df, ids="id", expected="expected", actual="label", score="score"):
    """Rows whose label is not the expected one, with a readable note."""
    note = F.concat(
        F.lit("Expected '"), F.col(expected), F.lit("', got '"), F.col(actual), F.lit("' (score="),
        F.format_number(F.col(score), 4), F.lit(")"),
    )
    return df.filter(F.col(expected) != F.col(actual)).select(ids, note.alias("note"))


def result_violations(df, result="result", tier=None):
    """Add ``violations``: which parts of the tier-result contract a row breaks; empty if none.

    ``tier`` is the tier number the metadata must carry, or None for any.
    """
    r = F.col(result)
    rules = [
        ("missing score", r["score"].isNull()),
        ("score out of range", ~r["score"].between(F.lit(0.0), F.lit(1.0))),
        ("unknown label", ~F.coalesce(r["label"].isin(K.PHISHING, K.BENIGN), F.lit(False))),
        ("unknown confidence", ~F.coalesce(r["confidence"].isin("high", "low"), F.lit(False))),
        ("missing escalate", r["escalate"].isNull()),
        ("missing metadata", r["metadata"].isNull() | r["metadata"]["model"].isNull()
         | r["metadata"]["threshold"].isNull() | r["metadata"]["tier"].isNull()),
    ]
    if tier is not None:
        rules.append(("wrong tier", r["metadata"]["tier"] != tier))
    found = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]
    return df.withColumn("violations", F.array_compact(F.array(*found)))


def require_valid_results(df, result="result", tier=None):
    """The rows unchanged; the job fails at the first row that breaks the contract."""
    checked = result_violations(df, result, tier)
    broken = F.size("violations") > 0
    message = F.concat(F.lit("invalid tier result: "), F.array_join("violations", ", "))
    return checked.filter(F.when(broken, F.raise_error(message).cast("boolean")).otherwise(True)).drop("violations")


def score_drift(left, right, ids="id", score="score", tolerance=K.SCORE_TOLERANCE):
    """Rows whose scores differ by more than ``tolerance`` between two scorings of the same ids."""
    joined = left.select(ids, F.col(score).alias("score_a")).join(
        right.select(ids, F.col(score).alias("score_b")), ids, "full_outer"
    )
    drift = F.abs(F.col("score_a") - F.col("score_b"))
    return joined.filter(F.coalesce(drift > tolerance, F.lit(True)))


def routing_stats(verdicts, tier_used="tier_used", forced="force_expert"):
    """(n_rows, expert_rows, escalated, forced) over final verdict rows."""
    expert = F.col(tier_used) == "3"
    was_forced = F.coalesce(F.col(forced), F.lit(False))
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(expert).alias("expert_rows"),
        F.count_if(expert & ~was_forced).alias("escalated"),
        F.count_if(expert & was_forced).alias("forced"),
    )
