"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, exact cosines."""

from dataclasses import dataclass
from math import acos, ceil, cos, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lurewatch.llm.graph import connected_components
from lurewatch.llm.words import mixed
from lurewatch.session import materialise


@dataclass(frozen=True)
class EmbeddingConfig:
    """``cosine``: least similarity of a link. ``sample``: rows the rotations are learned from. ``miss``: the share of
    links of just that similarity that may meet in no table, which sets the number of tables. ``bits``: the least
    bits of a table's part of a code; more with more vectors. ``apart``: bits of 64 by which the codes of linked
    vectors may differ. ``chunk``: vectors compared with as many others at a time. ``hops``: how often a group is
    joined to that of its leader."""

    cosine: float = 0.95
    sample: int = 16_384
    rounds: int = 30
    miss: float = 0.02
    bits: int = 16
    apart: int = 22
    chunk: int = 256
    hops: int = 3
    seed: int = 11


def tables_for(n, config=EmbeddingConfig()):
    """(tables, bits): parts of codes so long that buckets of ``n`` spread-out vectors stay small, and so many parts
    that two vectors of the least similarity differ in at most one bit of some part with probability 1 - miss.

    A bit of a code separates two vectors with probability angle / pi.
    """
    bits = max(config.bits, ceil(log2(max(n, 2))) + 2)
    same = 1 - acos(config.cosine) / pi
    near = same**bits + bits * (1 - same) * same ** (bits - 1)
    return ceil(np.log(config.miss) / np.log(1 - near)), bits


class Quantiser:
    """Rotations of the principal axes whose signs are codes; ``mean`` and ``planes`` (dimensions x bits)."""

    def __init__(self, sample, bits, config):
        """``sample``: unit vectors. Each round sets codes to the signs of the rotated data, then takes the rotation
        that brings the data closest to the codes. Vectors of few dimensions get several rotations, each from
        another random start, until there are enough bits."""
        rng = np.random.default_rng(config.seed)
        width = sample.shape[1]
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(width)
        data = sample - self.mean
        weights, axes = np.linalg.eigh(data.T @ data)
        axes = axes[:, np.argsort(-weights)]
        data, planes = data @ axes, []
        for _ in range(ceil(bits / width) if width else 0):
            rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
            for _ in range(config.rounds if len(sample) else 0):
                codes = np.where(data @ rotation >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(data.T @ codes)
                rotation = left @ right
            planes.append(axes @ rotation)
        self.planes = np.hstack(planes)[:, :bits] if planes else np.zeros((width, bits))

    def bits(self, units):
        return (units - self.mean) @ self.planes >= 0


def _unit_matrix(column, width):
    """Unit vectors of list values, padded with zeros."""
    offsets = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0]:offsets[-1]]
    out /= np.abs(out).max(axis=1, initial=0)[:, None]
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _coder(shared, tables, bits, width):
    """(id, w, v, code, parts, keys): the unit vector, 64 bits of its code, a key of each part of the code, and keys of
    each part without one of its bits. Two parts that differ in at most one bit share such a key."""
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    ones = ~powers
    with np.errstate(over="ignore"):
        salt = mixed(np.arange(1, tables * (bits + 1) + 1, dtype=np.uint64)).reshape(tables, bits + 1)

    def run(batches):
        quantiser = shared.value
        for batch in batches:
            units = _unit_matrix(batch.column("v"), width)
            signs, n = quantiser.bits(units), len(units)
            code = np.packbits(signs[:, :64], axis=1)
            code = np.hstack([code, np.zeros((n, 8 - code.shape[1]), np.uint8)]) if code.shape[1] < 8 else code
            parts = signs[:, : tables * bits].reshape(n, tables, bits).astype(np.uint64) @ powers
            with np.errstate(over="ignore"):
                whole = mixed(mixed(parts.copy()) + salt[None, :, 0])
                # A bit left out must not be taken for a bit that is 0: the salt tells which one it is.
                less = mixed(mixed(parts[:, :, None] & ones) + salt[None, :, 1:]).reshape(n, -1)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("w"),
                pa.array([r.tobytes() for r in units], pa.binary()), pa.array(np.ascontiguousarray(code).view(np.int64)[:, 0]),
                pa.FixedSizeListArray.from_arrays(pa.array(whole.view(np.int64).ravel()), tables).cast(pa.list_(pa.int64())),
                pa.FixedSizeListArray.from_arrays(pa.array(less.view(np.int64).ravel()), tables * bits).cast(pa.list_(pa.int64())),
            ], ["id", "w", "v", "code", "parts", "keys"])

    return run


def _matrix(blobs, width):
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, width)


def _leader_cosines(width):
    def run(batches):
        for batch in batches:
            x, y = (_matrix(batch.column(c).to_pylist(), width) for c in ("v", "leader_v"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("leader"), pa.array((x * y).sum(axis=1))], ["id", "leader", "cosine"])

    return run


def _labels(linked, a, b):
    """The smallest id in the connected component of each row and each column of ``linked``."""
    none = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], none).min(axis=0))
        new_a = np.minimum(a, np.where(linked, new_b[None, :], none).min(axis=1))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _comparer(width, config):
    """(id, n, root) for rows of two chunks: how many vectors, copies counted, of the other chunk each vector is linked
    with, and the smallest id it is connected with there."""

    def run(batches):
        for batch in batches:
            out = []
            columns = [batch.column(c) for c in ("ids", "ws", "vs", "ids_b", "ws_b", "vs_b")]
            same = batch.column("same").to_numpy(zero_copy_only=False)
            sizes_a, sizes_b = (np.diff(columns[i].offsets.to_numpy()) for i in (0, 3))
            single = (sizes_a == 1) & (sizes_b == 1) & ~same
            pick = pa.array(single)
            ids, ws, vs, ids_b, ws_b, vs_b = ([x[0] for x in c.filter(pick).to_pylist()] for c in columns)
            if ids:
                linked = (_matrix(vs, width) * _matrix(vs_b, width)).sum(axis=1) >= config.cosine
                u, v = np.array(ids, np.int64)[linked], np.array(ids_b, np.int64)[linked]
                root = np.minimum(u, v)
                out += [(u, np.array(ws_b, np.int64)[linked], root), (v, np.array(ws, np.int64)[linked], root)]
            for i in np.flatnonzero(~single).tolist():
                ids, ws, vs, ids_b, ws_b, vs_b = (c[i].as_py() for c in columns)
                a, b = np.array(ids, np.int64), np.array(ids_b, np.int64)
                linked = _matrix(vs, width) @ _matrix(vs_b, width).T >= config.cosine
                if same[i]:
                    np.fill_diagonal(linked, False)
                if linked.any():
                    root_a, root_b = _labels(linked, a, b)
                    n_a, n_b = linked @ np.array(ws_b, np.int64), np.array(ws, np.int64) @ linked
                    out.append((a[n_a > 0], n_a[n_a > 0], root_a[n_a > 0]))
                    if not same[i]:
                        out.append((b[n_b > 0], n_b[n_b > 0], root_b[n_b > 0]))
            arrays = [np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], ["id", "n", "root"])

    return run


def _led(coded, width, config):
    """(id, w, v, code, keys, cell, cosine): each vector in the cell of a leader it is linked with, or in its own.

    The leader is the smallest id in the fullest bucket of equal parts; buckets are counted before they move, and a
    vector asks for one leader. A leader may itself be led; leaders only have smaller ids, so a few hops bring a large
    group of copies, spread over several buckets, into few cells. Every hop is verified.
    """
    met = coded.select("id", F.explode("parts").alias("part"))
    full = met.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("leader")).filter("size > 1")
    best = met.join(materialise(full, "buckets"), "part").groupBy("id").agg(
        F.max(F.struct("size", (-F.col("leader")).alias("leader"))).alias("best"))
    asked = best.select("id", (-F.col("best.leader")).alias("leader")).filter("id <> leader")
    vectors = coded.select(F.col("id").alias("leader"), F.col("v").alias("leader_v"))

    def verified(pairs):
        both = pairs.join(coded.select("id", "v"), "id").join(vectors, "leader").select("id", "leader", "v", "leader_v")
        found = both.mapInArrow(_leader_cosines(width), "id bigint, leader bigint, cosine double")
        return materialise(found.filter(F.col("cosine") >= config.cosine), "led")

    led = verified(materialise(asked, "asked"))
    for _ in range(config.hops):
        upper = led.select(F.col("id").alias("leader"), F.col("leader").alias("next"))
        higher = led.join(upper, "leader").select("id", F.col("next").alias("leader"))
        moved = verified(materialise(higher, "asked"))
        led = materialise(led.join(moved.select("id"), "id", "left_anti").unionByName(moved), "led")
    return led


def similar_vectors(rows, ids="vec_id", vector="embedding", config=EmbeddingConfig()):
    """One row per row of ``rows``: (vec_id, n_links, component_id, kept).

    Two vectors are linked if their cosine, in double precision, is at least ``cosine``. ``n_links`` counts the other
    rows a row is found linked with; a component is named after its smallest id, whose row is kept.

    1. Equal vectors become one, with their number as weight.
    2. Rotations are learned from a sample; the signs of the rotated vectors are a code. Parts of the code are the
       tables. Pairs that differ in at most one bit of some part are found by what they share.
    3. Vectors that are linked with a common leader form a cell, cut into chunks, so that a large group of near copies
       is compared in blocks and never written out as pairs. Members within half the angle of a link from their leader
       are linked with each other for certain; they are only counted.
    4. Two cells are compared if any members share a key and, for single vectors, the whole codes are near enough.
       All links reported have an exact cosine. Links between vectors that share no key are missed: the tables are
       chosen so that this befalls about ``miss`` of the links of the least cosine, and fewer above it.

    Null, empty and zero vectors, and such with a null or infinite component or NaN, are linked with nothing. Vectors
    shorter than the longest count as ending in zeros. Rows that repeat an id count as rows of their own in
    ``n_links`` and share a component if they are linked. Rows without an id are linked with nothing, have no
    component and are kept. Empty tables give no rows. Other columns are not looked at.
    """
    spark = rows.sparkSession
    as_double = F.col(vector).cast("array<double>")
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(ids).isNotNull() & F.col(vector).isNotNull() & ~bad & F.exists(as_double, lambda x: x != 0)
    given = rows.select(
        F.col(ids).cast("bigint").alias("vec_id"), F.when(good, as_double).alias("v"))
    given = materialise(given.withColumn("hash", F.xxhash64("v")), "vectors")
    distinct = given.filter("v is not null").groupBy("hash", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"))
    # Different vectors of rows that share an id stay apart by a number of their own.
    distinct = materialise(distinct, "distinct-vectors")
    classes = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    clash = materialise(classes.select("id"), "shared-ids")
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 0
    tables, bits = tables_for(n, config)

    sample = distinct.orderBy(F.xxhash64("id", F.lit(config.seed)), "hash").limit(config.sample).select("v").toArrow()
    units = _unit_matrix(sample.combine_chunks().column("v").combine_chunks(), width) if n else np.zeros((0, width))
    shared = spark.sparkContext.broadcast(Quantiser(units, max(64, tables * bits), config))
    # Of different vectors with one id, all but the least get ids below every given one, for the search only.
    first = distinct.join(clash, "id", "left_anti").select("hash", "v", "id", "w")
    low = distinct.agg(F.min("id")).first()[0] or 0
    numbered = distinct.join(clash, "id").select("hash", "v", "id", "w")
    numbered = numbered.withColumn("at", F.xxhash64("hash", "id"))
    vertices = first.withColumn("vertex", F.col("id")).unionByName(
        numbered.withColumn("vertex", F.lit(low) - 1 - F.abs(F.col("at") % (1 << 61))).drop("at"))
    vertices = materialise(vertices, "vertices")
    coded = materialise(vertices.select(F.col("vertex").alias("id"), "w", "v").mapInArrow(
        _coder(shared, tables, bits, width),
        "id bigint, w bigint, v binary, code bigint, parts array<bigint>, keys array<bigint>"), "coded")
    return _linked(given, vertices, coded, width, config)


def _linked(given, vertices, coded, width, config):
    led = _led(coded, width, config)
    placed = materialise(coded.drop("parts").join(led, "id", "left").select(
        "id", "w", "v", "code", "keys", F.coalesce("leader", "id").alias("cell"), F.coalesce("cosine", F.lit(1.0)).alias("cosine"),
    ), "placed")
    # Inside half the angle, with room for rounding, two members of a cell are linked whatever their directions.
    inner = F.col("cosine") >= cos(acos(config.cosine) / 2) + 1e-9
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum(F.when(inner, F.col("w"))).alias("inner_w"))
    sizes = materialise(sizes, "cells")
    big = sizes.filter("members > 1")

    inside = placed.join(big, "cell").filter(inner).select(
        "id", (F.col("inner_w") - F.col("w")).alias("n"), F.lit(None).cast("bigint").alias("root"))

    chunked = placed.join(sizes.select("cell", "members"), "cell").withColumn("inner", inner & (F.col("members") > 1))
    spread = F.ceil(F.col("members") / (config.chunk / 2))
    chunked = chunked.groupBy("cell", "inner", F.pmod(F.xxhash64("id"), spread).alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("id", "w", "v"))).alias("rows"))
    chunked = materialise(chunked.select(
        "cell", "inner", "chunk", *(F.col(f"rows.{c}").alias(f"{c}s") for c in ("id", "w", "v"))), "chunks")
    other = chunked.select(*(F.col(c).alias(f"{c}_b") for c in chunked.columns))

    keys = placed.join(sizes.select("cell", "members"), "cell").select(
        F.explode("keys").alias("key"), "cell", F.when(F.col("members") == 1, F.col("code")).alias("code")).distinct()
    keys = materialise(keys, "keys")
    met = keys.groupBy("key").agg(F.min("cell").alias("a"), F.max("cell").alias("b")).filter("a <> b").select("key")
    keys = materialise(keys.join(met, "key"), "shared-keys")
    others = keys.select("key", F.col("cell").alias("cell_b"), F.col("code").alias("code_b"))
    near = F.coalesce(F.bit_count(F.col("code").bitwiseXOR(F.col("code_b"))) <= config.apart, F.lit(True))
    pairs = materialise(
        keys.join(others, "key").filter((F.col("cell") < F.col("cell_b")) & near).select("cell", "cell_b").distinct(), "cell-pairs")

    across = chunked.join(pairs, "cell").join(other, "cell_b").withColumn("same", F.lit(False))
    order, order_b = (F.struct(f"inner{x}", f"chunk{x}") for x in ("", "_b"))
    within = chunked.join(big.select("cell"), "cell").join(other, F.col("cell") == F.col("cell_b")).filter(
        (order <= order_b) & ~(F.col("inner") & F.col("inner_b"))).withColumn("same", order == order_b)
    wanted = ["ids", "ws", "vs", "ids_b", "ws_b", "vs_b", "same"]
    compared = across.select(*wanted).unionByName(within.select(*wanted)).mapInArrow(
        _comparer(width, config), "id bigint, n bigint, root bigint")
    links = materialise(inside.unionByName(compared), "links")

    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    edges = links.filter("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v")).distinct()
    edges = edges.unionByName(led.select(F.col("id").alias("u"), F.col("leader").alias("v")))
    roots = connected_components(edges)
    named = vertices.select("hash", "v", "id", "vertex", "w").join(
        roots.withColumnRenamed("root", "group"), "vertex", "left").select(
        "hash", "v", "id", "vertex", "w", F.coalesce("group", "vertex").alias("group"))
    named = materialise(named.join(counts.withColumnRenamed("id", "vertex"), "vertex", "left"), "named")
    least = named.groupBy("group").agg(F.min("id").alias("component_id"))
    named = named.join(materialise(least, "least"), "group").select(
        "hash", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    found = given.join(materialise(named, "classes"), ["hash", "v"], "left")
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
