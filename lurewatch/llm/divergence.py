"""How far the word counts of a source are from those of its language's other sources."""

import pickle
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch.llm.perfect_hash import PerfectHash
from lurewatch.session import materialise

# A-Z become a-z; a-z and every byte of a non-ASCII character stay; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20
HELD = 1 << 18
# 1,000,000,000 as a product: sums of up to 2.8e14 words then stay within 64 bits.
UNIT_A, UNIT_B = 32_000, 31_250
MOST_WORDS = 280_000_000_000_000


@dataclass(frozen=True)
class AuditConfig:
    """A term is kept with ``min_docs`` documents of its language; ``top`` terms are listed for a group.

    ``shard_bytes``: keys of one perfect hash; ``pass_bytes``: hashes broadcast at once, beyond which the
    documents are counted in several passes; ``slots``: counters a task holds before it hands them on;
    ``block`` and ``pack``: slots and sources compared at a time.
    """

    min_docs: int = 10
    top: int = 10
    shard_bytes: int = 256 << 10
    pass_bytes: int = 64 << 20
    slots: int = 4 << 20
    block: int = 4096
    pack: int = 32


def _pieces(text):
    """Lists of the terms of a text, about a megabyte at a time."""
    text, start = text.translate(LETTERS), 0
    while start < len(text):
        cut = text.find(b" ", start + PIECE)
        cut = len(text) if cut < 0 else cut
        yield text[start:cut].split()
        start = cut


def _strings(values):
    return pa.array(values, pa.binary()).cast(pa.string())


def _frequencies(batches):
    """(lang, term, n): documents that hold the term, summed over what the task holds at once."""
    held, size = {}, 0

    def flush():
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), _strings(list(counts)), pa.array(list(counts.values()), pa.int64())],
                ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            terms = set()
            for piece in _pieces(text):
                terms.update(piece)
            counts = held.setdefault(lang, Counter())
            size -= len(counts)
            counts.update(terms)
            size += len(counts)
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def _build(frame):
    import pandas as pd

    made = PerfectHash.build([t.encode() for t in frame["term"]])
    first = frame.iloc[0]
    return pd.DataFrame({"lang": [first["lang"]], "shards": [first["shards"]], "shard": [first["shard"]],
                         "n": [len(made)], "hash": [pickle.dumps(made.state(), 5)]})


def _expand(batches):
    """(lang, shard, slot, term) of every stored key."""
    for batch in batches:
        for lang, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "hash"))):
            made = PerfectHash(*pickle.loads(blob))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(made), pa.string()), pa.array([shard] * len(made), pa.int64()),
                 pa.array(np.arange(len(made))), _strings(made.keys())], ["lang", "shard", "slot", "term"])


def _shard_of(terms, shards):
    """Shard numbers by the first byte pairs of a hash; must agree in Spark and here, so both use CRC-32."""
    from zlib import crc32

    return np.fromiter((crc32(t) % shards for t in terms), np.int64, len(terms))


def _recount(shared, limit):
    """(lang, source, shard, slot, n): occurrences of stored keys, in dense counters per group and shard."""

    def run(batches):
        hashes = {}
        for lang, shards, shard, blob in shared.value:
            hashes.setdefault(lang, (shards, {}))[1][shard] = PerfectHash(*pickle.loads(blob))
        held, size = {}, 0

        def flush():
            for (lang, source, shard), counts in held.items():
                at = np.flatnonzero(counts)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                     pa.array([shard] * n, pa.int64()), pa.array(at), pa.array(counts[at])],
                    ["lang", "source", "shard", "slot", "n"])
            held.clear()

        for batch in batches:
            seen = {}
            for lang, source, text in zip(
                    batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                    batch.column("text").cast(pa.binary()).to_pylist()):
                if lang in hashes:
                    for piece in _pieces(text):
                        seen.setdefault((lang, source), Counter()).update(piece)
            for (lang, source), counter in seen.items():
                shards, made = hashes[lang]
                terms, times = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                places = _shard_of(terms, shards)
                for shard in np.unique(places).tolist():
                    if shard not in made:
                        continue  # another pass counts it
                    own = np.flatnonzero(places == shard)
                    slots = made[shard].slots([terms[i] for i in own])
                    if (lang, source, shard) not in held:
                        if size + len(made[shard]) > limit and held:
                            yield from flush()
                            size = 0
                        held[lang, source, shard] = np.zeros(len(made[shard]), np.int64)
                        size += len(made[shard])
                    kept = slots >= 0
                    held[lang, source, shard][slots[kept]] += times[own[kept]]
        yield from flush()

    return run


def shares(counts, total):
    """1 + floor(10**9 * (count + 2) / total), exactly, for an array of counts."""
    a = UNIT_A * (counts + 2)
    return 1 + UNIT_B * (a // total) + UNIT_B * (a % total) // total


def _share_column(count, total):
    a = (count + 2) * F.lit(UNIT_A).cast("bigint")
    part = F.call_function("div", (a % total) * F.lit(UNIT_B).cast("bigint"), total)
    return 1 + F.lit(UNIT_B).cast("bigint") * F.call_function("div", a, total) + part


def _divergence_column(p, q):
    return F.call_function("div", (p - q) * (p - q), p + q)


def _compare(config):
    """(lang, a, b, value): summed divergence of each two sources, over one block of slots of two packs."""

    def dense(cells, totals, size):
        counts = np.zeros((len(totals), size), np.int64)
        if cells:
            at = np.array([(c["at"], c["place"], c["n"]) for c in cells], np.int64)
            counts[at[:, 0], at[:, 1]] = at[:, 2]
        return np.stack([shares(row, total) for row, total in zip(counts, totals)])

    def run(batches):
        for batch in batches:
            out = {"lang": [], "a": [], "b": [], "value": []}
            for r in batch.to_pylist():
                p = dense(r["cells"], r["totals"], r["size"])
                q = p if r["pack"] == r["pack_b"] else dense(r["cells_b"], r["totals_b"], r["size"])
                for i in range(len(p)):
                    first = i + 1 if r["pack"] == r["pack_b"] else 0
                    if first == len(q):
                        continue
                    d = q[first:] - p[i]
                    value = (d * d // (q[first:] + p[i])).sum(axis=1)
                    out["lang"] += [r["lang"]] * len(value)
                    out["a"] += [r["pack"] * config.pack + i] * len(value)
                    out["b"] += [r["pack_b"] * config.pack + first + j for j in range(len(value))]
                    out["value"] += value.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), *(pa.array(out[c], pa.int64()) for c in ("a", "b", "value"))],
                ["lang", "a", "b", "value"])

    return run


def kept_terms(docs, config=AuditConfig()):
    """(lang, term) of the terms in enough documents of their language; exact. ``docs``: lang, text, no nulls."""
    found = docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= config.min_docs).select("lang", "term")


def perfect_hashes(kept, config=AuditConfig()):
    """(lang, shards, shard, n, hash): the kept terms of a language, in perfect hashes of bounded size.

    The number of shards follows from the size of all terms, so no task gets a whole language.
    """
    size = kept.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    shards = F.lit(max(1, -(-size // config.shard_bytes))).cast("bigint")
    placed = kept.withColumn("shards", shards).withColumn("shard", F.crc32(F.col("term").cast("binary")) % F.col("shards"))
    return placed.groupBy("lang", "shards", "shard").applyInPandas(
        _build, "lang string, shards bigint, shard bigint, n bigint, hash binary")


def group_counts(docs, hashes, config=AuditConfig()):
    """(lang, source, shard, slot, n): exact occurrences of each kept term in each group, none if zero.

    Hashes of at most about ``pass_bytes`` are broadcast at a time; every pass reads the documents once.
    """
    spark = docs.sparkSession
    total = hashes.agg(F.sum(F.octet_length("hash") + 64)).first()[0] or 0
    passes = max(1, -(-total // config.pass_bytes))
    parts = []
    for i in range(passes):
        mine = hashes.filter(F.pmod(F.xxhash64("lang", "shard"), F.lit(passes)) == i)
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine.select("lang", "shards", "shard", "hash").collect()])
        found = docs.mapInArrow(
            _recount(shared, config.slots), "lang string, source string, shard bigint, slot bigint, n bigint")
        parts.append(materialise(found.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")), "group-counts"))
        shared.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _pair_values(counts, groups, hashes, config):
    """(lang, a, b, value): summed divergence of the sources numbered a < b of each language."""
    pack = F.col("number") % config.pack
    packs = groups.groupBy("lang", F.floor(F.col("number") / config.pack).alias("pack")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("number", "total"))), lambda s: s["total"]).alias("totals"))
    blocks = hashes.select("lang", "shard", "n", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("n") - 1) / config.block))).alias("block"))
    blocks = blocks.select(
        "lang", "shard", "block", F.least(F.lit(config.block), F.col("n") - F.col("block") * config.block).alias("size"))
    cells = counts.join(groups.select("lang", "source", "number"), ["lang", "source"]).groupBy(
        "lang", "shard", F.floor(F.col("slot") / config.block).alias("block"), F.floor(F.col("number") / config.pack).alias("pack"),
    ).agg(F.collect_list(F.struct(pack.alias("at"), (F.col("slot") % config.block).alias("place"), "n")).alias("cells"))
    grid = materialise(blocks.join(packs, "lang").join(cells, ["lang", "shard", "block", "pack"], "left"), "blocks")
    other = grid.select("lang", "shard", "block", *(F.col(c).alias(f"{c}_b") for c in ("pack", "totals", "cells")))
    pairs = grid.join(other, ["lang", "shard", "block"]).filter("pack <= pack_b")
    found = pairs.mapInArrow(_compare(config), "lang string, a bigint, b bigint, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs, text="text", lang="lang", source="source", config=AuditConfig()):
    """(lang, source, part, item, value, rank): how each group (lang, source) differs.

    Part ``pair``: every other source of the language, farthest first. Part ``term``: the ``top`` kept terms
    that the group uses more than its language as a whole, by their divergence. Ties go by the item's bytes.

    1. Document frequencies of all terms are summed exactly; frequent ones stay.
    2. They are put into minimal perfect hashes with the keys beside them, in shards of bounded size.
    3. A second pass over the texts counts them in dense slots per group, checking each key byte by byte.
    4. Counts of all sources of a language are compared block by block, zero counts included.

    Null text, language and source count as ''. A language without kept terms has pair values of 0. Repeated
    rows are counted each time. Texts are cut between terms, about a megabyte at a time, so long ones need no
    more memory; a single term is held whole. No rows, no result. Other columns are not looked at. More than
    2.8e14 words in a group are refused, since sums would leave 64 bits.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                         for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = materialise(kept_terms(docs, config), "kept-terms")
    hashes = materialise(perfect_hashes(kept, config), "perfect-hashes")
    counts = group_counts(docs, hashes, config)

    sizes = hashes.groupBy("lang").agg(F.sum("n").alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    words, v = F.coalesce("words", F.lit(0).cast("bigint")), F.coalesce("v", F.lit(0).cast("bigint"))
    checked = F.when(words + 2 * v > MOST_WORDS, F.raise_error(F.lit("a group has too many words"))).otherwise(words + 2 * v)
    groups = groups.select(
        "lang", "source", words.alias("words"), v.alias("v"), checked.cast("bigint").alias("total"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("number"))
    groups = materialise(groups, "groups")

    values = _pair_values(counts, groups, hashes, config)
    both = values.unionByName(values.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", F.col("number").alias("a"), "source")
    others = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"))
    pairs = names.join(others, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))

    whole = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("all"))
    totals = groups.groupBy("lang").agg((F.sum("words") + 2 * F.max("v")).cast("bigint").alias("all_total"))
    p, q = _share_column(F.col("n"), F.col("total")), _share_column(F.col("all"), F.col("all_total"))
    terms = (
        counts.join(groups.select("lang", "source", "total"), ["lang", "source"])
        .join(whole, ["lang", "shard", "slot"]).join(totals, "lang")
        .select("lang", "source", "shard", "slot", p.alias("p"), q.alias("q")).filter("p > q")
        .select("lang", "source", "shard", "slot", _divergence_column(F.col("p"), F.col("q")).alias("value"))
    )
    stored = hashes.select("lang", "shard", "hash").mapInArrow(_expand, "lang string, shard bigint, slot bigint, term string")
    terms = terms.join(stored, ["lang", "shard", "slot"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= config.top))
