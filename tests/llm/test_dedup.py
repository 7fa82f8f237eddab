"""Exact and near duplicates against brute force."""

from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lurewatch.llm import exact_dedup, graph, near_dedup
from lurewatch.llm.words import alnum_words, space_words


def near_by_hand(rows, k=4, percent=80):
    sets = {}
    for i, text in rows:
        w = [x for x in (text or "").lower().replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and 100 * common >= percent * union:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants(n, seed=3):
    """Copies of a few texts, each with some words changed; chains of ever more distant texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [rng.choice(vocabulary, 120).tolist() for _ in range(4)]
    rows = []
    for i in range(n):
        words = list(bases[i % 4])
        for at in rng.integers(0, len(words), rng.integers(0, 6)):
            words[at] = rng.choice(vocabulary)
        if i % 4 == 3:
            bases[3] = words
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_marks(awkward, keep):
    rows = exact_dedup.mark_exact_copies(awkward, keep=keep).toArrow().to_pylist()
    pick = min if keep == "smallest" else max
    fox = [r for r in rows if r["group_size"] == 4]
    assert len(rows) == 8 and len(fox) == 4
    assert {r["keep_id"] for r in fox} == {pick(1, 2)}
    assert [r["kept"] for r in fox if r["doc_id"] is None] == [False]
    empty = [r for r in rows if r["doc_id"] in (3, 4)]
    assert {r["text_sha256"] for r in empty} == {sha256(b"").hexdigest()}
    assert {r["keep_id"] for r in empty} == {pick(3, 4)}


@pytest.mark.parametrize("keep,left", [("smallest", {1, 3, 5, 6}), ("largest", {2, 4, 5, 6})])
def test_exact_drop_keeps_columns(awkward, keep, left):
    kept = exact_dedup.drop_exact_copies(awkward, keep=keep)
    assert kept.columns == awkward.columns
    rows = kept.toArrow().to_pylist()
    assert sorted(r["doc_id"] for r in rows) == sorted(left)
    assert {r["doc_id"]: r["text"] for r in rows}.get(4, None) is None


def test_empty_tables(nothing):
    assert exact_dedup.mark_exact_copies(nothing).count() == 0
    assert exact_dedup.drop_exact_copies(nothing).count() == 0
    assert near_dedup.near_components(nothing).count() == 0
    assert near_dedup.drop_near_copies(nothing).columns == nothing.columns


def test_near_awkward(awkward):
    rows = near_dedup.near_components(awkward).toArrow().to_pylist()
    assert len(rows) == 8
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"] and by_id[1]["kept"]
    assert by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == 0 and by_id[3]["kept"] and by_id[4]["kept"]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[5]["n_shingles"] == 1 and by_id[6]["n_shingles"] == 1
    assert near_dedup.drop_near_copies(awkward).count() == 6


def test_near_against_all_pairs(spark):
    rows = variants(160)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"])
             for r in near_dedup.near_components(docs).toArrow().to_pylist()}
    assert found == near_by_hand(rows)


@pytest.mark.parametrize("seed,edits", [(1, 3), (2, 6), (3, 9), (4, 14)])
def test_open_pairs_hold_every_link_between_components(spark, seed, edits):
    """A group of copies with up to ``edits`` changed words each, some of them shared, around a far or near pivot."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 90, rng.integers(0, edits + 1)):
            words[at] = f"n{rng.integers(0, 2)}"
        texts.append((i, " ".join(words[: 90 - rng.integers(0, 12)])))
    sets = {i: near_dedup.shingle_set(t, 4) for i, t in texts}
    config = near_dedup.NearConfig()
    vertices = spark.createDataFrame([(i, len(s), int(rng.integers(1, 9))) for i, s in sets.items()], "_id bigint, _n bigint, _popular bigint")
    groups = spark.createDataFrame([(i, 0) for i in sets], "vertex bigint, root bigint")
    pivot = min(vertices.collect(), key=lambda r: (-r["_popular"], r["_id"]))["_id"]
    linked = {i for i in sets if near_dedup._similar(sets[i], sets[pivot], config)}
    components = spark.createDataFrame([(i, min(linked)) for i in linked], "vertex bigint, root bigint")
    docs = spark.createDataFrame(texts, "_id bigint, _text string")
    links, pairs = near_dedup._open_pairs(vertices, groups, components, docs, config)
    found = {(r["u"], r["v"]) for r in pairs.collect()}
    assert {(r["u"], r["v"]) for r in links.collect()} == {(i, pivot) for i in linked - {pivot}}
    wanted = {(b, a) for a in sets for b in sets if a < b and not (a in linked and b in linked)
              and pivot not in (a, b) and near_dedup._similar(sets[a], sets[b], config)}
    assert wanted <= found
    assert not any(a in linked and b in linked for a, b in found)


def siblings(n, rng):
    """``n`` near copies of two texts that share two thirds of their words, half of each."""
    stem = [f"s{i}" for i in range(100)]
    tails = [[f"{c}{i}" for i in range(50)] for c in "ab"]
    rows = []
    for i in range(n):
        words = stem + tails[i % 2]
        words[int(rng.integers(0, 150))] = f"n{i}"
        rows.append((i, " ".join(words)))
    return rows


def test_copies_of_sibling_texts_are_paired_by_component(spark):
    """What all of a component differ in from the pivot pairs none of its members."""
    sizes = {}
    for n in (60, 180):
        rows = siblings(n, np.random.default_rng(5))
        sets = {i: near_dedup.shingle_set(t, 4) for i, t in rows}
        vertices = spark.createDataFrame([(i, len(s), 2 if i == 0 else 1) for i, s in sets.items()], "_id bigint, _n bigint, _popular bigint")
        groups = spark.createDataFrame([(i, 0) for i in sets], "vertex bigint, root bigint")
        components = spark.createDataFrame([(i, i % 2) for i in sets], "vertex bigint, root bigint")
        seen = []
        paired = near_dedup._meeting_components

        def watched(*args):
            seen.append((args[0], paired(*args)))
            return seen[-1][1]

        near_dedup._meeting_components = watched
        try:
            near_dedup._open_pairs(vertices, groups, components, spark.createDataFrame(rows, "_id bigint, _text string"), near_dedup.NearConfig())
        finally:
            near_dedup._meeting_components = paired
        ranked, met = seen[0]
        far, near = ranked.filter("_as_far").join(met, ["v", "_e", "_root"]), ranked.filter("_as_any")
        others = near.select("v", "_e", F.col("_root").alias("_w_root"))
        sizes[n] = far.join(others, ["v", "_e", "_w_root"]).count()
    assert sizes[180] <= 4 * max(sizes[60], 60), sizes


def test_near_copies_of_sibling_texts(spark):
    rows = siblings(80, np.random.default_rng(6))
    found = near_dedup.near_components(spark.createDataFrame(rows, "doc_id bigint, text string")).toArrow().to_pylist()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == near_by_hand(rows)


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 1000))
def test_circulant_signature_is_the_least_of_each_shift(values, seed):
    circulant = near_dedup.Circulant(16, seed)
    hashes = np.array(sorted(values), np.uint64)
    got = circulant.signature(hashes)
    table = circulant.windows[:, 0]
    n = 1 << near_dedup.UNIVERSE_BITS
    slots = [int(h) >> (64 - near_dedup.UNIVERSE_BITS) for h in sorted(values)]
    for k in range(16):
        best = min(range(len(slots)), key=lambda j: (int(table[(slots[j] + k) % n]), j))
        assert int(got[k]) == int(hashes[best])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    found = graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).toArrow().to_pylist()
    roots = {r["vertex"]: r["root"] for r in found}
    assert len(found) == len(roots) == 41 + 31
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in range(200, 230)} == {100}
    assert graph.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_words():
    assert space_words("A b\x0bÉc d") == [b"a", "b".encode(), "Éc d".encode()]
    assert alnum_words("A-b1 Éc!—d") == [b"a", b"b1", "Éc".encode(), "—d".encode()]
    assert alnum_words(None) == space_words("") == []
