"""Benchmark passages in documents, found with one Aho-Corasick automaton over normalised word windows."""

from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lurewatch.llm.words import alnum_words
from lurewatch.session import materialise

WINDOW = 10
#: Bytes of benchmark texts that one automaton takes, some 120 MB a million; a larger benchmark is scanned in slices.
AUTOMATON_BYTES = 1_500_000
#: Places of the table of word pairs, as a power of two; one byte each.
PAIR_BITS = 23


def windows(words, size=WINDOW):
    """The runs of ``size`` words; all words as one window if there are fewer, but not none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WindowAutomaton:
    """The automaton of all windows of ``items`` ((id, text) pairs) over numbers of words instead of characters.

    Words get numbers from 1; 0 stands for every word of a text that no item has, so no window holds it. A node
    is one word of one window, about a sixth of the nodes that characters would need.

    The automaton looks at the next words of a node one after the other, and its root has very many. So only those
    stretches of a text are given to it in which each word follows the one before it in some window, as a table of
    word pairs tells; a pair that only shares its place in the table with another costs time and changes nothing.
    """

    def __init__(self, items, size=WINDOW):
        self.numbers, self.ids = {}, []
        owners, places = {}, {}
        for item, text in items:
            place = places.setdefault(str(item), len(places))
            for window in windows(alnum_words(text), size):
                key = tuple([self.numbers.setdefault(w, len(self.numbers) + 1) for w in window])
                owners[key] = owners[key] | {place} if key in owners else frozenset([place])
        self.ids = list(places)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if owners else None
        self.shortest = min(map(len, owners), default=0)
        self.follows, shared = np.zeros(1 << PAIR_BITS, bool), {}
        for window, items_of in owners.items():
            value = (len(window), items_of)
            self.automaton.add_word(window, shared.setdefault(value, value))
            numbers = np.array(window)
            self.follows[self._pair_places(numbers)] = True
        if owners:
            self.automaton.make_automaton()

    @staticmethod
    def _pair_places(numbers):
        numbers = numbers.astype(np.uint64)
        mixed = numbers[:-1] * np.uint64(0x9E3779B97F4A7C15) + numbers[1:] * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _stretches(self, words):
        """(first word, numbers) of the stretches that may hold a window."""
        get = self.numbers.get
        numbers = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        follows = self.follows[self._pair_places(numbers)] & (numbers[:-1] > 0) & (numbers[1:] > 0)
        starts = np.concatenate([[0], np.flatnonzero(~follows) + 1])
        stops = np.concatenate([starts[1:], [len(numbers)]])
        for i in np.flatnonzero((stops - starts >= self.shortest) & (numbers[starts] > 0)):
            yield int(starts[i]), tuple(numbers[starts[i] : stops[i]].tolist())

    def scan(self, words):
        """(start and end word of every hit stretch, merged; ids of the items found) of one text."""
        if self.automaton is None or not words:
            return [], set()
        found, places = [], set()
        for first, numbers in self._stretches(words):
            for end, (n, owners) in self.automaton.iter(numbers):
                found.append((first + end + 1 - n, first + end + 1))
                places |= owners
        spans = []
        for start, stop in sorted(found):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([start, stop])
        return spans, {self.ids[p] for p in places}


def _scanned(batch, automaton):
    """n_words, and the spans and items found, of the texts of a batch."""
    counts, starts, stops, items = [], [], [], []
    for text in batch.column("_text").to_pylist():
        words = alnum_words(text)
        spans, ids = automaton.scan(words)
        counts.append(len(words))
        starts.append([s for s, _ in spans]), stops.append([e for _, e in spans]), items.append(sorted(ids))
    return [pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64())),
            pa.array(items, pa.list_(pa.string()))]


FOUND = "_n_words bigint, _starts array<bigint>, _stops array<bigint>, _items array<string>"


def _scanner(packed, size):
    def run(batches):
        automaton = WindowAutomaton(packed.value, size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *_scanned(batch, automaton)], ["doc_id", "_n_words", "_starts", "_stops", "_items"])

    return run


def _hit_texts(packed, size):
    """The keys of the texts with hits, with their spans and items."""

    def run(batches):
        automaton = WindowAutomaton(packed.value, size)
        for batch in batches:
            _, starts, stops, items = _scanned(batch, automaton)
            table = pa.RecordBatch.from_arrays([batch.column("_key"), starts, stops, items], ["_key", "_starts", "_stops", "_items"])
            yield table.filter(pc.greater(pc.list_value_length(starts), 0))

    return run


def _word_counts(batches):
    for batch in batches:
        counts = [len(alnum_words(t)) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_key"), pa.array(counts, pa.int64())], ["doc_id", "_key", "_n_words"])


def _key(text):
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _hits_by_slice(texts, parts, size):
    """(_key, _starts, _stops, _items) of the texts with hits, slice after slice.

    What a slice finds is written, so one automaton and one broadcast are alive at a time, whatever their number.
    """
    found, context = None, texts.sparkSession.sparkContext
    keyed = texts.select("_text", _key(F.col("_text")).alias("_key"))
    for part in parts:
        packed = context.broadcast(part)
        hits = keyed.mapInArrow(_hit_texts(packed, size), FOUND.replace("_n_words bigint", "_key string"))
        hits = materialise(hits.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("_starts", "_stops", "_items")]), "slice-hits")
        packed.destroy()
        found = hits if found is None else found.unionByName(hits)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("_starts", "_stops", "_items")]
    return materialise(found.groupBy("_key").agg(*lists), "hit-texts")


def _finisher(batches):
    """Hit words and items of each row from the spans of all passes."""
    for batch in batches:
        hits, items, digests, merged = [], [], [], []
        rows = zip(*(batch.column(n).to_pylist() for n in ("_starts", "_stops", "_items")))
        for starts, stops, ids in rows:
            covered, spans = 0, []
            for s, e in sorted(zip(starts, stops)):
                s = max(s, covered)
                if e > s:
                    spans.append((s, e))
                    covered = e
            hits.append(sum(e - s for s, e in spans))
            ids = sorted(set(ids))
            items.append(len(ids)), digests.append(sha256(",".join(ids).encode()).hexdigest()), merged.append(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_n_words"), pa.array(hits, pa.int64()), pa.array(items, pa.int64()),
             pa.array(digests, pa.string()), pa.array([h > 0 for h in hits], pa.bool_()),
             pa.array(merged, pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
        )


def _slices(benchmark, item, text, limit):
    """(number, slices): the items in slices of at most ``limit`` bytes of text (or one item), read one at a time."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    name = F.coalesce(F.col(item).cast("string"), F.lit("null"))
    rows = benchmark.select(name.alias("i"), F.col(text).alias("t"), size.alias("b"))
    total = rows.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("s")).first()["s"]
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, ([(r["i"], r["t"]) for r in rows.filter(part == k).select("i", "t").distinct().toLocalIterator()] for k in range(n))


def find_contamination(docs, benchmark, ids="doc_id", text="text", item="item_id", item_text="text",
                       size=WINDOW, automaton_bytes=AUTOMATON_BYTES):
    """One row per row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids).

    Texts and items are cut into words (``alnum_words``). A word of a text is hit if it lies inside an
    occurrence of a window: ``size`` consecutive words of an item, or all words of a shorter one. Null and
    empty texts have no words and no hits; items without words have no windows; a null item id is the id
    "null". Very long texts are read whole, one at a time. Repeated rows and items change nothing, and windows
    that several items have belong to all of them. No items: nothing is hit. Other columns are not looked at.

    The text is scanned once, in place and without a shuffle. The benchmark goes to every task, which builds
    the automaton, so its size is checked: beyond ``automaton_bytes`` of item text it is cut into slices of
    about half that size. Then each slice's hits are written by the hash of the text and joined at the end.
    """
    rows = docs.select(F.col(ids).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n, parts = _slices(benchmark, item, item_text, automaton_bytes)
    if n == 1:
        packed = docs.sparkSession.sparkContext.broadcast(next(parts))
        rows = rows.mapInArrow(_scanner(packed, size), f"doc_id {kind}, {FOUND}")
    else:
        hits = _hits_by_slice(rows, parts, size)
        counted = rows.withColumn("_key", _key(F.col("_text"))).mapInArrow(
            _word_counts, f"doc_id {kind}, _key string, _n_words bigint")
        rows = counted.join(hits, "_key", "left").select("doc_id", "_n_words", *[
            F.coalesce(c, F.array().cast(t)).alias(c)
            for c, t in (("_starts", "array<bigint>"), ("_stops", "array<bigint>"), ("_items", "array<string>"))])
    return rows.mapInArrow(
        _finisher,
        f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
        "item_ids array<string>",
    )


def drop_contaminated(docs, benchmark, text="text", item="item_id", item_text="text", size=WINDOW,
                      automaton_bytes=AUTOMATON_BYTES):
    """The rows of ``docs`` without any hit, with all their columns; one scan and no shuffle, slices as above."""
    n, parts = _slices(benchmark, item, item_text, automaton_bytes)
    if n == 1:
        packed = docs.sparkSession.sparkContext.broadcast(next(parts))
        return docs.mapInArrow(_clean(packed, size, text), docs.schema)
    hits = _hits_by_slice(docs.select(F.col(text).alias("_text")), parts, size)
    return docs.join(hits.select("_key"), _key(docs[text]) == F.col("_key"), "left_anti")


def _clean(packed, size, text):
    def run(batches):
        automaton = WindowAutomaton(packed.value, size)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            yield batch.filter(pa.array([not automaton.scan(alnum_words(t))[0] for t in texts], pa.bool_()))

    return run
