"""Similar vectors and hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import embedding_dedup as E
from lurewatch.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, id string, hash int"


def table(spark, rows):
    """Rows (id, vector, label) with extra columns of names used inside."""
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, "x", 2) for i, v, y in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def groups_of_copies(n, noise, width=32, seed=4):
    """Near copies of a few vectors, one group of a third of all, chains that drift away, and vectors of their own."""
    rng = np.random.default_rng(seed)
    out, last = [], rng.normal(size=width)
    centre = rng.normal(size=width)
    for i in range(n):
        if i % 3 == 0:
            v = centre / np.linalg.norm(centre) + noise * rng.normal(size=width) / np.sqrt(width)
        elif i % 7 == 1:
            last = v = last / np.linalg.norm(last) + 0.25 * rng.normal(size=width) / np.sqrt(width)
        else:
            v = rng.normal(size=width)
        out.append(np.float32(v * rng.uniform(0.1, 10)))
    return out


def links_by_hand(rows, cosine=0.95):
    """{row: (links, component)} of usable rows (id, vector), given in any order, and the linked pairs."""
    kept = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows)]
    width = max(len(v) for _, _, v in kept)
    m = np.array([np.pad(v, (0, width - len(v))) for _, _, v in kept])
    m /= np.linalg.norm(m, axis=1)[:, None]
    linked = m @ m.T >= cosine
    np.fill_diagonal(linked, False)
    root = np.array([i for _, i, _ in kept])
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], 1 << 60).min(axis=1))
        if (new == root).all():
            return linked.sum(axis=1).tolist(), root.tolist(), linked
        root = new


@pytest.mark.parametrize("noise", [0.02, 0.25])
def test_similar_vectors_find_the_links(spark, noise):
    vectors = groups_of_copies(420, noise)
    vectors[5] = vectors[8] = vectors[11] = vectors[2]  # copies
    vectors[14] = vectors[2] * 2
    rows = [(3 * i + 1, v) for i, v in enumerate(vectors)]
    links, roots, linked = links_by_hand(rows)
    got = {r["vec_id"]: r for r in E.similar_vectors(table(spark, [(i, v, 0) for i, v in rows])).collect()}
    assert len(got) == len(rows)
    found = [got[i]["n_links"] for i, _ in rows]
    assert all(a <= b for a, b in zip(found, links))  # nothing below the least cosine
    assert sum(found) >= 0.97 * sum(links) and sum(links) > 10_000 * (noise < 0.25)
    right = [got[i]["component_id"] == r for (i, _), r in zip(rows, roots)]
    assert np.mean(right) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_tables_grow_with_the_vectors():
    assert E.tables_for(10_000)[1] == 16 and E.tables_for(10**9)[1] == 32
    for n in (10, 10**5, 10**9):
        tables, bits = E.tables_for(n)
        same = 1 - np.arccos(0.95) / np.pi
        assert (1 - same**bits - bits * (1 - same) * same ** (bits - 1)) ** tables <= 0.02


def test_similar_vectors_odd_rows(spark):
    rows = [(1, [1, 0, 0], 0), (2, None, 0), (3, [], 0), (4, [0, 0, 0], 0), (5, [1, None, 0], 0), (6, [1, float("nan"), 0], 0),
            (7, [float("inf"), 0, 0], 0), (8, [2, 0], 0), (9, [1e30, 0, 1e25], None), (None, [1, 0, 0], 0), (1, [1, 0, 0], 0),
            (1, [0, 1, 0], 0), (10, [0, 3, 0], 0), (11, [-1, 0, 0], 0)]
    got = sorted(E.similar_vectors(table(spark, rows)).toArrow().to_pylist(), key=repr)
    assert len(got) == len(rows)
    seen = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None)
    assert seen == [(1, 1, 1, True), (1, 3, 1, True), (1, 3, 1, True), *((i, 0, i, True) for i in range(2, 8)),
                    (8, 3, 1, False), (9, 3, 1, False), (10, 1, 1, False), (11, 0, 11, True)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]


def test_empty_tables(spark):
    nothing = table(spark, [(1, [1.0], 0)]).limit(0)
    assert E.similar_vectors(nothing).count() == 0
    assert H.hard_negatives(nothing, F.col("vec_id") % 2 == 0).count() == 0


def mined_by_hand(rows, anchor, config):
    rows = [(i, y, np.floor(np.array(v, float) * config.scale)) for i, v, y in rows]
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, y, np.pad(v, (0, width - len(v)))) for i, y, v in rows]
    out = []
    for i, y, v in rows:
        if anchor(i):
            scores = sorted((-int(v @ w), j, z) for j, z, w in rows if j != i)
            for p, pos, _ in [s for s in scores if s[2] == y][: config.positives]:
                fits = [s for s in scores if s[2] != y and config.low * -p <= 100 * -s[0] <= config.high * -p]
                out += [(i, pos, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fits[: config.negatives])]
    return sorted(out)


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("config", [
    H.MiningConfig(), H.MiningConfig(bucket=16, groups=3, anchors=7, selective=0.0), H.MiningConfig(bucket=40, selective=0.3, low=50),
    H.MiningConfig(bucket=16, groups=5, focus=1, selective=0.8, low=95),
])
def test_hard_negatives_against_brute_force(spark, config):
    rng = np.random.default_rng(8)
    vectors = groups_of_copies(300, 0.3, width=12)
    vectors[4] = vectors[7] = vectors[10]
    vectors[13] = vectors[13] * 0
    rows = [(i * 2, np.round(v, 2), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    got = H.hard_negatives(table(spark, rows), F.col("vec_id") % 12 == 0, config=config).toArrow().to_pylist()
    by_hand = mined_by_hand([(i, np.float32(v), y) for i, v, y in rows], lambda i: i % 12 == 0, config)
    assert sorted(tuple(r[n] for n in NAMES) for r in got) == by_hand and len(by_hand) > 100


def test_hard_negatives_odd_rows(spark):
    good = [(0, [1, 0], 1), (1, [1, 0], 1), (2, [0.9, 0], 2), (3, [0.9], 2), (4, [0, 0], 2), (8, [-1, 0], 1)]
    bad = [(5, [1, 0], None), (6, None, 1), (7, [1, None], 1), (9, [float("nan"), 0], 2), (None, [1, 0], 2)]
    got = H.hard_negatives(table(spark, good + bad + good[:3]), F.col("vec_id") % 8 == 0).toArrow().to_pylist()
    assert sorted(tuple(r[n] for n in NAMES) for r in got) == mined_by_hand(good, lambda i: i % 8 == 0, H.MiningConfig())


def test_ranges_keep_every_row_that_can_matter():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 6))
    bucket = H.Bucket(np.arange(400), np.zeros(400), vectors)
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    narrow = 0
    for q in units[:50]:
        for threshold in (0.3, 0.6, 0.9, 0.99):
            found = set(bucket.candidates(q, threshold, 4).tolist())
            assert set(np.flatnonzero(units @ q >= threshold).tolist()) <= found
            narrow += threshold >= 0.9 and len(found) < 100
    assert narrow > 90
