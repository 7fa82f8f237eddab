"""Hard negatives of anchors by coordinate pruning in length buckets."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch.session import materialise

NEVER = np.iinfo(np.int64).max
SLACK = 1e-9


@dataclass(frozen=True)
class MiningConfig:
    """``positives`` best rows of an anchor's label; for each of them ``negatives`` rows of other labels that score
    at least ``low`` and at most ``high`` hundredths of it. ``scale`` quantises components.

    ``bucket``: rows of a length bucket; ``focus``: coordinates whose ranges are intersected; ``selective``: the
    least threshold, as a cosine, at which ranges are worth intersecting; ``anchors``: anchors a task holds at
    once; ``groups``: tasks among which the rows are dealt for each set of anchors.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    bucket: int = 2048
    focus: int = 4
    selective: float = 0.6
    anchors: int = 16_384
    groups: int = 64


class Bucket:
    """Rows of similar length: unit vectors, and for every coordinate the rows sorted by it."""

    def __init__(self, ids, labels, vectors):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.longest = lengths.max()
        self.units = vectors / np.maximum(lengths, 1e-300)[:, None]
        self.order = np.argsort(self.units, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.units.T, self.order, axis=1)

    def candidates(self, unit, threshold, focus):
        """Places of all rows whose cosine with ``unit`` may reach ``threshold`` > 0.

        A unit vector p with q . p >= t has p_f between q_f t - w and q_f t + w, w = sqrt((1 - t^2)(1 - q_f^2)),
        or beyond where q_f itself lies outside -t to t. The ranges of the coordinates in which the anchor is
        largest are found in the sorted lists, and the narrowest list is reduced by the other ranges.
        """
        best, ranges = None, []
        for f in np.argsort(-np.abs(unit))[:focus]:
            q = unit[f]
            width = np.sqrt(max(0.0, 1 - threshold * threshold) * max(0.0, 1 - q * q)) + SLACK
            low = -2.0 if q <= -threshold else q * threshold - width
            high = 2.0 if q >= threshold else q * threshold + width
            start, end = np.searchsorted(self.sorted[f], low, "left"), np.searchsorted(self.sorted[f], high, "right")
            ranges.append((f, low, high))
            if best is None or end - start < best[2] - best[1]:
                best = f, start, end
        found = self.order[best[0], best[1]:best[2]]
        for f, low, high in ranges:
            if f != best[0]:
                values = self.units[found, f]
                found = found[(values >= low) & (values <= high)]
        return found


class Tops:
    """The best ``k`` rows seen for each of ``n`` searches: highest score first, ties by smaller id."""

    def __init__(self, n, k):
        self.scores, self.ids, self.k = np.full((n, k), -np.inf), np.full((n, k), NEVER), k

    def add(self, i, scores, ids):
        worth = scores >= self.scores[i, -1]
        if worth.any():
            scores, ids = np.append(self.scores[i], scores[worth]), np.append(self.ids[i], ids[worth])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores[i], self.ids[i] = scores[order], ids[order]


class PositiveSearch:
    """The best rows of the anchors' own labels."""

    def __init__(self, anchors, config):
        self.anchors, self.tops = anchors, Tops(len(anchors.ids), config.positives)

    def thresholds(self):
        return self.tops.scores[:, -1]

    def add(self, i, scores, ids, labels):
        own = (labels == self.anchors.labels[i]) & (ids != self.anchors.ids[i])
        self.tops.add(i, scores[own], ids[own])

    def rows(self):
        for i, anchor in enumerate(self.anchors.ids.tolist()):
            for score, found in zip(self.tops.scores[i].tolist(), self.tops.ids[i].tolist()):
                if found != NEVER:
                    yield anchor, None, None, found, int(score)


class NegativeSearch:
    """For each positive of the anchors, the best rows of other labels in its range of scores."""

    def __init__(self, anchors, config):
        self.anchors, self.config = anchors, config
        self.tops = [Tops(len(p), config.negatives) for p in anchors.positives]

    def thresholds(self):
        out = np.full(len(self.tops), np.inf)
        for i, (tops, positives) in enumerate(zip(self.tops, self.anchors.positives)):
            for j, (_, score) in enumerate(positives):
                if score >= 0:
                    out[i] = min(out[i], max(self.config.low * score / 100, tops.scores[j, -1]))
        return out

    def add(self, i, scores, ids, labels):
        other = labels != self.anchors.labels[i]
        scores, ids = scores[other], ids[other]
        for j, (_, positive) in enumerate(self.anchors.positives[i]):
            fits = (100 * scores >= self.config.low * positive) & (100 * scores <= self.config.high * positive)
            if fits.any():
                self.tops[i].add(j, scores[fits], ids[fits])

    def rows(self):
        for i, (anchor, positives) in enumerate(zip(self.anchors.ids.tolist(), self.anchors.positives)):
            for j, (positive, positive_score) in enumerate(positives):
                for score, found in zip(self.tops[i].scores[j].tolist(), self.tops[i].ids[j].tolist()):
                    if found != NEVER:
                        yield anchor, positive, positive_score, found, int(score)


class Anchors:
    def __init__(self, ids, labels, vectors, positives):
        self.ids, self.labels, self.vectors, self.positives = ids, labels, vectors, positives
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.units = vectors / np.maximum(self.lengths, 1e-300)[:, None]


def search(goal, anchors, bucket, config):
    """Show ``goal`` every row of ``bucket`` that can still matter to an anchor, with its exact score.

    Anchors that no row of this length can satisfy are passed over; those with a threshold too low for ranges to
    exclude much get all scores of the bucket at once.
    """
    needed = goal.thresholds()
    reach = anchors.lengths * bucket.longest
    alive = np.flatnonzero((needed <= reach * (1 + SLACK)) & (needed < np.inf))
    cosines = np.where(reach > 0, needed / np.maximum(reach, 1e-300), 0.0)
    pruned = cosines[alive] >= config.selective
    for i in alive[pruned].tolist():
        found = bucket.candidates(anchors.units[i], min(1.0, cosines[i]) - SLACK, config.focus)
        if len(found):
            goal.add(i, bucket.vectors[found] @ anchors.vectors[i], bucket.ids[found], bucket.labels[found])
    rest = alive[~pruned]
    for start in range(0, len(rest), 256):
        part = rest[start:start + 256]
        for i, scores in zip(part.tolist(), anchors.vectors[part] @ bucket.vectors.T):
            goal.add(i, scores, bucket.ids, bucket.labels)


def _vectors(column, width):
    """A matrix of list values, zeros after the end of shorter ones."""
    offsets = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    if (sizes == width).all():
        return values[offsets[0]:offsets[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width))
    for i, size in enumerate(sizes):
        out[i, :size] = values[offsets[i]:offsets[i + 1]]
    return out


def _searcher(kind, width, config):
    """Streams of rows, sorted by (set of anchors, group), anchors first, then rows from the longest down."""

    def table(rows):
        return [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]

    def run(batches):
        state = {"key": None, "waiting": [], "rows": []}

        def finish():
            if state.get("goal") is not None:
                flush_rows(True)
                found = list(state["goal"].rows())
                for start in range(0, len(found), 50_000):
                    yield pa.RecordBatch.from_arrays(table(found[start:start + 50_000]), NAMES)

        def flush_rows(everything):
            while state["rows"] and (everything or sum(len(r) for r in state["rows"]) >= config.bucket):
                rows = pa.Table.from_batches(state["rows"]).combine_chunks()
                part, rest = rows.slice(0, config.bucket), rows.slice(config.bucket)
                state["rows"] = rest.to_batches() if len(rest) else []
                part = part.combine_chunks().to_batches()[0]
                bucket = Bucket(part.column("id").to_numpy(), part.column("label").to_numpy(), _vectors(part.column("v"), width))
                search(state["goal"], state["anchors"], bucket, config)

        def begin():
            """All anchors of a key are known once its first row comes."""
            whole = pa.Table.from_batches(state["waiting"]).combine_chunks().to_batches()[0]
            positives = [[(p["id"], p["score"]) for p in ps or []] for ps in whole.column("positives").to_pylist()]
            state["anchors"] = Anchors(
                whole.column("id").to_numpy(), whole.column("label").to_numpy(), _vectors(whole.column("v"), width), positives)
            state["goal"], state["waiting"] = kind(state["anchors"], config), []

        for batch in batches:
            keys = batch.column("set").to_numpy() * config.groups + batch.column("group").to_numpy()
            rows = batch.column("is_row").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(rows.astype(np.int8)) != 0)) + 1
            for start, end in zip(np.append(0, cuts), np.append(cuts, len(keys))):
                if start == end:
                    continue
                part, key = batch.slice(start, end - start), keys[start]
                if key != state["key"]:
                    yield from finish()
                    state.update(key=key, goal=None, waiting=[], rows=[])
                if not rows[start]:
                    state["waiting"].append(part)
                elif state["goal"] is not None or state["waiting"]:
                    if state["goal"] is None:
                        begin()
                    state["rows"].append(part)
                    flush_rows(False)
        yield from finish()

    return run


NAMES = ["anchor_id", "positive_id", "positive_score", "id", "score"]
FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
POSITIVES = "array<struct<id: bigint, score: bigint>>"


def _searched(kind, rows, anchors, width, config):
    """Each set of anchors meets every row in one of ``groups`` streams; the answers of all streams together.

    The streams are sorted by Spark, which spills; a task holds one set of anchors and one bucket of rows.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    sets = max(1, -(-n_anchors // config.anchors))
    groups = max(1, min(config.groups, -(-n_rows // config.bucket)))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    own_group = F.pmod(F.xxhash64("id"), F.lit(groups))
    own_set = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(sets))
    none = F.lit(None).cast(POSITIVES)
    dealt = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"), own_group.cast("int").alias("group"),
        F.lit(True).alias("is_row"), "id", "label", "v", none.alias("positives"), length.alias("_length"))
    asked = anchors.select(
        own_set.cast("int").alias("set"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(False).alias("is_row"), "id", "label", "v", "positives", length.alias("_length"))
    streams = dealt.unionByName(asked).repartition(sets * groups, "set", "group").sortWithinPartitions(
        "set", "group", "is_row", F.desc("_length"), "id").drop("_length")
    return streams.mapInArrow(_searcher(kind, width, config), FOUND)


def hard_negatives(rows, anchor, ids="vec_id", vector="embedding", label="label", config=MiningConfig()):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``.

    ``anchor``: a condition on the columns of ``rows`` that picks anchors. Components x count as floor(scale * x)
    and a score is the inner product with the anchor. Higher scores come first, ties by smaller id. An anchor's
    positives are its first few other rows of the same label; its negatives for a positive are the first few
    rows of other labels in the range of scores that the positive allows. No such rows, no result rows.

    The rows are dealt to streams, longest first, and cut into length buckets with sorted coordinate lists. A
    bucket is searched with the worst score that could still enter the result as threshold: a bucket of too
    short rows ends it; else feasible ranges of the anchor's largest coordinates are intersected, and the rows in
    all of them get exact scores. Results are the same as of comparing everything.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Of rows that
    repeat an id, the least by label, then vector takes part. Vectors shorter than the longest count as ending in
    zeros. Zero vectors score 0 with everything. A negative positive score allows no negatives. Scores are
    exact while sums stay below 2**53. Empty tables give no rows. Other columns are not looked at.
    """
    made = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * config.scale).cast("double"))
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = rows.select(
        F.col(ids).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), made.alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        (F.col(vector).isNotNull() & ~bad).alias("good"),
    ).filter("id is not null and label is not null and good")
    first = F.min(F.struct("label", "v", "anchor")).alias("r")
    given = materialise(given.groupBy("id").agg(first).select("id", "r.label", "r.v", "r.anchor"), "mining-rows")
    width = given.agg(F.max(F.size("v"))).first()[0] or 0

    anchors = given.filter("anchor").select("id", "label", "v", F.lit(None).cast(POSITIVES).alias("positives"))
    found = _searched(PositiveSearch, given, anchors, width, config)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    positives = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= config.positives)
    positives = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asked = anchors.drop("positives").join(positives, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    asked = materialise(asked, "mining-anchors")

    found = _searched(NegativeSearch, given, asked, width, config)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= config.negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
