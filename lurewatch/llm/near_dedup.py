"""Near duplicates by circulant MinHash, banding, and exact Jaccard verification on whole shingle sets."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch.llm.graph import connected_components
from lurewatch.llm.words import gram_hashes, mixed, space_words, word_hashes
from lurewatch.session import materialise

UNIVERSE_BITS = 20
BLOCK = 1024


@dataclass(frozen=True)
class NearConfig:
    """``percent`` is the least similarity in hundredths. A pair of just that similarity meets in none of the
    ``bands`` with probability (1 - s**rows)**bands: 8e-6 for 64 bands of 8 rows at 0.8."""

    shingle: int = 4
    percent: int = 80
    bands: int = 64
    rows: int = 8
    seed: int = 7


class Circulant:
    """Signatures of ``size`` coordinates from two permutations of the universe.

    The first permutation is the bijective mix inside the shingle hashes, of which the top bits are a place in
    the universe. The second is a table; coordinate k uses it shifted circularly by k, so the values of one
    place for all coordinates lie side by side and one strided gather serves them all. A coordinate is the
    full 64-bit hash of the shingle that has the least value, not the value itself.
    """

    def __init__(self, size, seed):
        n = 1 << UNIVERSE_BITS
        table = np.random.default_rng(seed).permutation(n).astype(np.uint32)
        self.place = np.empty(n, np.int64)
        self.place[table] = np.arange(n)
        self.size = size
        ring = np.concatenate([table, table[:size]])
        self.windows = np.lib.stride_tricks.sliding_window_view(ring, size)
        self.shift = np.arange(size)

    def signature(self, hashes):
        """``hashes``: a sorted, non-empty array of distinct shingle hashes."""
        slots = (hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
        least = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(slots), BLOCK):
            np.minimum(least, self.windows[slots[i : i + BLOCK]].min(axis=0), out=least)
        winner = (self.place[least] - self.shift) & ((1 << UNIVERSE_BITS) - 1)
        return hashes[np.searchsorted(slots, winner)]


def shingle_set(text, k):
    """Sorted distinct hashes of the k-word shingles; the whole sequence is one shingle if it is shorter."""
    return np.unique(gram_hashes(word_hashes(space_words(text)), k))


def _signer(config):
    def run(batches):
        circulant = Circulant(config.bands * config.rows, config.seed)
        factors = mixed(np.arange(1, config.rows + 1, dtype=np.uint64)) | np.uint64(1)
        tags = mixed(np.arange(1, config.bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, keys, short, bands = [], [], [], []
            for text in batch.column("_text").to_pylist():
                found = shingle_set(text, config.shingle)
                sizes.append(len(found))
                if not len(found):
                    keys.append(None), short.append(None), bands.append(None)
                    continue
                key = xxhash.xxh3_128_digest(found.tobytes())
                rows = circulant.signature(found).reshape(config.bands, config.rows)
                keys.append(key), short.append(int.from_bytes(key[:8], "little", signed=True))
                bands.append(mixed((rows * factors).sum(axis=1, dtype=np.uint64) + tags).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(short, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["_id", "n_shingles", "_set", "_short", "_bands"],
            )

    return run


def signatures(docs, ids="doc_id", text="text", config=NearConfig()):
    """(_id, n_shingles, _set, _short, _bands) of each row; ``_set`` is a 128-bit hash of the whole set."""
    return docs.select(F.col(ids).cast("bigint").alias("_id"), F.col(text).alias("_text")).mapInArrow(
        _signer(config), "_id bigint, n_shingles bigint, _set binary, _short bigint, _bands array<bigint>"
    )


def _similar(a, b, config):
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= config.percent * (len(a) + len(b) - common)


def _set_pairs(batch, config):
    """The whole shingle sets of each row's two texts; rows come sorted by the second."""
    last, other = None, None
    for x, p in zip(batch.column("_x_text").to_pylist(), batch.column("_p_text").to_pylist()):
        if p != last:
            last, other = p, shingle_set(p, config.shingle)
        yield shingle_set(x, config.shingle), other


def _verifier(config):
    def run(batches):
        for batch in batches:
            mask = pa.array([_similar(a, b, config) for a, b in _set_pairs(batch, config)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"]
            )

    return run


def _differ(config):
    """(u, v, _n, _pn, _linked, _diff) of pairs (u, v): ``_diff`` is what one of the two sets has and not the other."""

    def run(batches):
        for batch in batches:
            sizes, others, linked, diffs = [], [], [], []
            for a, b in _set_pairs(batch, config):
                sizes.append(len(a)), others.append(len(b)), linked.append(_similar(a, b, config))
                diffs.append(np.setxor1d(a, b, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(sizes, pa.int64()), pa.array(others, pa.int64()),
                 pa.array(linked, pa.bool_()), pa.array(diffs, pa.list_(pa.int64()))],
                ["u", "v", "_n", "_pn", "_linked", "_diff"])

    return run


def _with_texts(pairs, texts):
    """Pairs (u, v) with both texts. Both joins can split a hot document."""
    with_x = pairs.join(texts.select(F.col("_id").alias("u"), F.col("_text").alias("_x_text")), "u")
    with_p = with_x.join(texts.select(F.col("_id").alias("v"), F.col("_text").alias("_p_text")), "v")
    return with_p.select("u", "v", "_x_text", "_p_text")


def _verified(pairs, texts, config):
    """The pairs (u, v) whose whole shingle sets are similar enough."""
    return _with_texts(pairs, texts).mapInArrow(_verifier(config), "u bigint, v bigint")


def _comparable(a, b, config):
    """No pair of sets of these sizes can be similar enough otherwise."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * config.percent


def near_components(docs, ids="doc_id", text="text", config=NearConfig()):
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Documents are linked if the Jaccard similarity of their shingle sets is at least ``percent`` hundredths;
    a component is named after its smallest id, and that document is kept. Null and empty texts have no
    shingles and are linked with nothing. Rows without an id are linked with nothing, have a null component
    and are kept. Rows that repeat an id are one document; with different texts, that document has the links
    of all of them. No rows, no result rows. Other columns of ``docs`` are not looked at.

    1. Equal sets are one vertex: the smallest id that has the set.
    2. Only vertices in a band bucket with another set matter further; buckets are found with a
       pre-aggregated minimum and maximum, so a bucket of any size is a single row.
    3. Each vertex is compared with one pivot, the vertex of its buckets with the fullest buckets, which in a
       large group of near copies is close to what they were copied from. Components follow.
    4. Buckets that share vertices form groups. In a group with more than one component, vertices are described
       by how they differ from one pivot of the group. Two similar vertices that are not both linked with that
       pivot must share a known number of differences, so they share one of the rarest few (``_open_pairs``).
       Only such pairs are compared. No candidate pair is left out, and what all members of a group have in
       common does not pair them.

    Very long texts are read whole, one at a time. Ties between pivots go to the smaller id. Ids are cast to bigint.
    """
    signed = materialise(signatures(docs, ids, text, config), "signed")
    held = signed.filter("_id is not null and n_shingles > 0")
    vertices = materialise(held.groupBy("_set").agg(F.min("_id").alias("_vertex")), "vertices")

    members = held.select("_id", "n_shingles", "_short", F.explode("_bands").alias("_band"))
    shared = members.groupBy("_band").agg(F.min("_short").alias("_a"), F.max("_short").alias("_b")).filter("_a <> _b")
    shared = materialise(shared.select("_band"), "shared-bands")
    met = materialise(
        members.select("_id", F.col("n_shingles").alias("_n"), "_band").join(shared, "_band")
        .join(vertices.select(F.col("_vertex").alias("_id")), "_id", "left_semi").distinct(), "met")

    candidates = materialise(met.select("_id").distinct(), "candidates")
    texts = materialise(
        docs.select(F.col(ids).cast("bigint").alias("_id"), F.col(text).alias("_text"))
        .join(candidates, "_id", "left_semi"), "candidate-texts")

    sizes, pivots, pairs = _pivots(met, config)
    edges = materialise(_verified(pairs, texts, config), "near-links")
    groups = connected_components(pivots.select("u", "v"))
    links, rest = _open_pairs(sizes, groups, connected_components(edges), texts, config)
    edges = edges.unionByName(links).unionByName(materialise(_verified(rest, texts, config), "near-links"))

    roots = connected_components(edges).select(F.col("vertex").alias("_vertex"), "root")
    named = vertices.join(roots, "_vertex", "left").select("_set", F.coalesce("root", "_vertex").alias("_root"))
    named = materialise(named, "components")
    return signed.join(named, "_set", "left").select(
        F.col("_id").alias("doc_id"), "n_shingles",
        F.when(F.col("_id").isNotNull(), F.coalesce("_root", "_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _pivots(met, config):
    """(vertices, bucket pivots, pairs to compare).

    ``vertices``: (_id, _n, _popular), where the popularity of a vertex is the number of vertices in its
    buckets. ``bucket pivots``: (u, v) of each vertex and the most popular vertex of each of its buckets.
    ``pairs``: each vertex with the most popular of those, if their sizes allow a link.
    """
    sizes = materialise(met.groupBy("_band").agg(F.count(F.lit(1)).alias("_size")), "bucket-sizes")
    popular = met.join(sizes, "_band").groupBy("_id").agg(F.max("_n").alias("_n"), F.sum("_size").alias("_popular"))
    popular = materialise(popular, "popular")
    ranked = materialise(met.select("_band", "_id").join(popular, "_id"), "ranked")
    best = F.max(F.struct("_popular", (-F.col("_id")).alias("_id"), F.col("_n").alias("_pn")))
    tops = materialise(ranked.groupBy("_band").agg(best.alias("_p")), "tops")
    near = ranked.join(tops, "_band").select(
        F.col("_id").alias("u"), (-F.col("_p._id")).alias("v"), "_n", F.col("_p._pn").alias("_pn"), F.col("_p._popular").alias("_top"))
    near = near.filter("u <> v").groupBy("u", "v").agg(*[F.max(c).alias(c) for c in ("_n", "_pn", "_top")])
    near = materialise(near, "bucket-pivots")
    pairs = near.filter(_comparable(F.col("_n"), F.col("_pn"), config)).groupBy("u").agg(
        F.max(F.struct("_top", (-F.col("v")).alias("_v"))).alias("_p"))
    return popular, near, materialise(pairs.select("u", (-F.col("_p._v")).alias("v")), "pivot-pairs")


def _open_pairs(vertices, groups, components, texts, config):
    """(links, pairs) of groups with more than one component: the vertices (u, v) that are linked with the
    pivot v of their group, and each other pair once that may be similar and is not in one component.

    ``vertices``: (_id, _n, _popular); ``groups`` and ``components``: (vertex, root).

    Let p be the pivot of a group and D(x) the symmetric difference of the sets x and p. Two sets are similar
    if they differ in at most k (|x| + |y|) shingles, with k = (1 - s) / (1 + s), and they differ in
    |D(x)| + |D(y)| - 2 c shingles, where c is the number of common differences. Similar sets differ in at
    most a(x) = |x| (1 - s) / s shingles, whence c >= |D(x)| - a(x), and the same for y. If x is not linked
    with p, also c > (|D(y)| + k (|p| - |y|)) / 2. With all differences of a group in one order, rarest
    first, two vertices with c common ones share one among the first |D| - c + 1 of either; and after the first
    that they share, both must have enough places left for the others. Differences that only one vertex has
    take up places but pair nobody. Components are paired before their members are (``_meeting_components``).
    """
    s = config.percent / 100
    k = (1 - s) / (1 + s)
    named = vertices.join(groups.select(F.col("vertex").alias("_id"), F.col("root").alias("_group")), "_id")
    placed = named.join(components.select(F.col("vertex").alias("_id"), "root"), "_id", "left").select(
        "_id", "_group", "_popular", F.coalesce("root", "_id").alias("_root"))
    placed = materialise(placed, "placed")
    split = placed.groupBy("_group").agg(
        F.max(F.struct("_popular", (-F.col("_id")).alias("_id"))).alias("_p"),
        F.min("_root").alias("_low"), F.max("_root").alias("_high"),
    ).filter("_low <> _high").select("_group", (-F.col("_p._id")).alias("v"))
    members = placed.join(materialise(split, "split-groups"), "_group").filter("_id <> v")
    members = materialise(members.select(F.col("_id").alias("u"), "v", "_root"), "split-members")
    pairs = _with_texts(members.select("u", "v"), texts)
    described = materialise(pairs.mapInArrow(
        _differ(config), "u bigint, v bigint, _n bigint, _pn bigint, _linked boolean, _diff array<bigint>"), "differences")

    each = described.select("u", "v", F.explode("_diff").alias("_e"))
    shared = each.groupBy("v", "_e").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    common = each.join(materialise(shared, "shared-differences"), ["v", "_e"])
    own = Window.partitionBy("u")
    common = common.select(
        "u", "v", "_e", F.count(F.lit(1)).over(own).alias("_shared"),
        F.row_number().over(own.orderBy("_times", "_e")).alias("_rank"))
    facts = described.select("u", "_n", "_pn", "_linked", F.size("_diff").alias("_d")).join(members.select("u", "_root"), "u")
    common = common.join(facts, "u")

    # Rounding must not lose a pair: bounds give way by a little.
    least = F.ceil(F.col("_d") - F.col("_n") * ((1 - s) / s) - 1e-6)
    least_far = F.greatest(least, F.floor((F.col("_d") + k * (F.col("_pn") - F.col("_n"))) / 2 - 1e-6) + 1, F.lit(1))
    place = F.col("_d") - F.col("_shared") + F.col("_rank")
    ranked = materialise(common.select(
        "u", "v", "_e", "_n", "_root", "_d", place.alias("_place"),
        (~F.col("_linked") & (place <= F.col("_d") - F.greatest(least, F.lit(1)) + 1)).alias("_as_far"),
        (place <= F.col("_d") - least_far + 1).alias("_as_any"),
    ).filter("_as_far or _as_any"), "rare-differences")
    met = _meeting_components(ranked, k, config)
    far = ranked.filter("_as_far").join(met, ["v", "_e", "_root"])
    others = ranked.filter("_as_any").select(
        "v", "_e", F.col("u").alias("_w"), F.col("_n").alias("_wn"), F.col("_root").alias("_w_root"),
        F.col("_d").alias("_wd"), F.col("_place").alias("_w_place"))
    slack = k * (F.col("_n") + F.col("_wn")) + 1e-6
    left = F.least(F.col("_d") - F.col("_place"), F.col("_wd") - F.col("_w_place")) + 1
    found = far.join(others, ["v", "_e", "_w_root"]).filter(
        _comparable(F.col("_n"), F.col("_wn"), config)
        & (F.abs(F.col("_d") - F.col("_wd")) <= slack) & (2 * left >= F.col("_d") + F.col("_wd") - slack))
    pairs = found.select(F.greatest("u", "_w").alias("u"), F.least("u", "_w").alias("v")).distinct()
    return described.filter("_linked").select("u", "v"), materialise(pairs, "open-pairs")


def _meeting_components(ranked, k, config):
    """(v, _e, _root, _w_root): components with members at one difference of which some pair may be similar.

    Members of one component are never paired. Each component is one row per difference with the bounds of its
    members, so a difference that ten thousand members of one component have meets nothing, and two components
    are joined only if the bounds leave a pair possible.
    """
    room = F.col("_d") - F.col("_place")
    bounds = ranked.groupBy("v", "_e", "_root").agg(
        F.min("_n").alias("_n0"), F.max("_n").alias("_n1"), F.min("_d").alias("_d0"), F.max("_d").alias("_d1"),
        F.max(F.when(F.col("_as_far"), room)).alias("_far"), F.max(F.when(F.col("_as_any"), room)).alias("_any"))
    bounds = materialise(bounds, "component-bounds")
    several = bounds.groupBy("v", "_e").agg(
        F.min("_root").alias("_low"), F.max("_root").alias("_high")).filter("_low <> _high").select("v", "_e")
    bounds = materialise(bounds.join(several, ["v", "_e"], "left_semi"), "meeting-bounds")
    others = bounds.filter("_any is not null").select(
        "v", "_e", *[F.col(c).alias(f"_w{c}") for c in ("_root", "_n0", "_n1", "_d0", "_d1", "_any")])
    c = F.col
    slack = k * (c("_n1") + c("_w_n1")) + 1e-6
    return bounds.filter("_far is not null").join(others, ["v", "_e"]).filter(
        (c("_root") != c("_w_root"))
        & (c("_n1") * 100 >= c("_w_n0") * config.percent) & (c("_w_n1") * 100 >= c("_n0") * config.percent)
        & (F.greatest(c("_d0") - c("_w_d1"), c("_w_d0") - c("_d1")) <= slack)
        & (2 * (F.least("_far", "_w_any") + 1) >= c("_d0") + c("_w_d0") - slack)
    ).select("v", "_e", "_root", c("_w_root").alias("_w_root"))


def drop_near_copies(docs, ids="doc_id", text="text", config=NearConfig()):
    """The rows of ``docs`` that ``near_components`` keeps, with all their columns."""
    gone = near_components(docs, ids, text, config).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[ids].cast("bigint") == gone["_gone"], "left_anti")
