"""Language identification with interpolated Kneser-Ney character models."""

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lurewatch.llm.words import BASE, mixed

UNKNOWN = "und"
_letters = re.compile(r"[^\W\d_]+").findall
#: Words a worker remembers, and what is scored at once.
MAX_CACHED = 250_000
PART_WORDS, PART_CHARS = 50_000, 1_000_000
#: Discount of Kneser-Ney, and the share of probability for characters never seen in training.
DISCOUNT = 0.75
UNSEEN = 1e-6
#: Characters from which a text counts as long, the share of calibration texts that sets the usual excess in bits
#: per character, and the least excess that counts as usual.
LONG = 1000
QUANTILE = 0.98
LEAST_EXCESS = 0.25


@dataclass(frozen=True)
class LanguageConfig:
    """``sample_rows`` bounds the training rows of each language (about as many, the same in each run);
    one in ``calibration`` of them sets the rejection and is not counted in the models."""

    order: int = 4
    sample_rows: int = 1500
    calibration: int = 5
    slack: float = 4.0


def letter_runs(text):
    """Lower-cased runs of letters."""
    return _letters(text.lower()) if text else []




def _grams(words, n):
    """Counts of the n-grams of characters inside bordered words."""
    counts = Counter()
    for word, times in words.items():
        marked = f" {word} "
        for i in range(1, len(marked)):
            if i + 1 >= n:
                counts[marked[i + 1 - n : i + 1]] += times
    return counts


def kneser_ney(words, order):
    """{gram: (probability, weight)} from word counts: interpolated Kneser-Ney over all orders.

    ``probability`` is that of the last character after the ones before it. ``weight`` is what a context
    leaves to the next lower order; only grams that occur as contexts have one other than 1. The highest
    order counts occurrences, lower ones count the different characters in front. Grams that begin with a
    word's border mark have nothing in front and keep their own counts.
    """
    counts = [None] + [_grams(words, n) for n in range(1, order + 1)]
    for n in range(order - 1, 0, -1):
        fronts = Counter(g[1:] for g in counts[n + 1])
        counts[n] = Counter({g: c if g[0] == " " and n > 1 else fronts[g] or c for g, c in counts[n].items()})
    model = {}
    total = sum(counts[1].values())
    base = DISCOUNT * len(counts[1]) / total if total else 1.0
    for g, c in counts[1].items():
        model[g] = [(1 - UNSEEN) * (max(c - DISCOUNT, 0) / total + base / len(counts[1])), 1.0]
    for n in range(2, order + 1):
        context, kinds = Counter(), Counter()
        for g, c in counts[n].items():
            context[g[:-1]] += c
            kinds[g[:-1]] += 1
        weights = {h: DISCOUNT * kinds[h] / context[h] for h in context}
        for h, w in weights.items():
            if h in model:
                model[h][1] = w
            else:
                model[h] = [0.0, w]
        for g, c in counts[n].items():
            p = max(c - DISCOUNT, 0) / context[g[:-1]] + weights[g[:-1]] * model.get(g[1:], [UNSEEN])[0]
            model.setdefault(g, [0.0, 1.0])[0] = p
    return model


def gram_keys(codes, order):
    """[keys of the 1-grams, ..., keys of the ``order``-grams] that end at each place of an array of code points.

    A gram that would begin before the array has a meaningless key; callers know which places those are.
    """
    codes = codes.astype(np.uint64) + np.uint64(1)
    keys, sums, power = [], np.zeros(len(codes), np.uint64), 1
    for n in range(1, order + 1):
        sums[n - 1 :] += codes[: len(codes) - n + 1] * np.uint64(power)
        power = power * BASE % 2**64
        keys.append(mixed(sums + np.uint64(n * 0x51ED270B)))
    return keys


def _codes(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(texts):
    """(place of the first, word counts of each) of up to 200 texts with up to ``MAX_CACHED`` words, or of one text."""
    first, counted, held = 0, [], 0
    for i, text in enumerate(texts):
        words = Counter(letter_runs(text))
        if counted and (len(counted) == 200 or held + len(words) > MAX_CACHED):
            yield first, counted
            first, counted, held = i, [], 0
        counted.append(words)
        held += len(words)
    if counted:
        yield first, counted


class LanguageModels:
    """The models of all languages in arrays sorted by the hash of the gram.

    Row i of ``probability`` and ``weight`` holds one column per language. A gram that a language has not
    seen has probability 0 there, and scoring backs off to the next lower order with the context's weight.
    """

    def __init__(self, languages, hashes, probability, weight, limits=None):
        self.languages, self.hashes, self.probability, self.weight = languages, hashes, probability, weight
        self.limits = limits
        self.forget()

    def forget(self):
        """Drop the remembered words."""
        self._places = {}
        self._known = np.empty((1024, len(self.languages) + 1))

    @classmethod
    def fit(cls, words_of, order):
        languages = sorted(words_of)
        models = [kneser_ney(words_of[name], order) for name in languages]
        grams = sorted({g for m in models for g in m})
        hashes = np.array([gram_keys(_codes(g), len(g))[-1][-1] for g in grams], np.uint64)
        by_hash = np.argsort(hashes, kind="stable")
        grams = [grams[i] for i in by_hash]
        probability = np.array([[m.get(g, (0.0, 1.0))[0] for m in models] for g in grams], np.float32)
        weight = np.array([[m.get(g, (0.0, 1.0))[1] for m in models] for g in grams], np.float32)
        shape = (len(grams), len(languages))
        return cls(languages, hashes[by_hash], probability.reshape(shape), weight.reshape(shape))

    def _score_words(self, words, order):
        """Negative log2 probability of each word in each language, borders included.

        All words stand in one array with a border mark between them. Every character but the first mark is
        predicted from those before it, back to the mark that begins its word.
        """
        codes = _codes(f" {' '.join(words)} ")
        marks = np.flatnonzero(codes == 32)
        places = np.arange(len(codes))
        begin = marks[np.maximum(np.searchsorted(marks, places) - 1, 0)]
        p = lower = None
        for n, keys in enumerate(gram_keys(codes, order), 1):
            at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
            there = self.hashes[at] == keys
            seen = np.where(there[:, None], self.probability[at], 0.0)
            if n == 1:
                p = np.where(seen > 0, seen, UNSEEN)
            else:
                context, known = np.roll(lower[0], 1), np.roll(lower[1], 1)
                backed_off = np.where(known[:, None], self.weight[context], 1.0) * p
                full = (places - begin >= n - 1)[:, None]
                p = np.where(full, np.where(seen > 0, seen, backed_off), p)
            lower = at, there
        return np.add.reduceat(-np.log2(np.maximum(p[1:], 1e-12)), marks[:-1], axis=0)

    def _scores(self, words, order):
        """(first, rows) for parts of a list of words, bounded in words and characters: a word's scores and its length."""
        first = chars = 0
        for i, word in enumerate(words):
            chars += len(word) + 1
            if i + 1 == len(words) or i + 1 - first == PART_WORDS or chars >= PART_CHARS:
                part = words[first : i + 1]
                lengths = np.fromiter((len(w) + 1 for w in part), np.float64, len(part))
                yield first, np.column_stack([self._score_words(part, order), lengths])
                first, chars = i + 1, 0

    def _learn(self, words, order):
        """Remember the scores and lengths of new words."""
        n = len(self._places)
        if n + len(words) > len(self._known):
            grown = np.empty((2 * (n + len(words)), self._known.shape[1]))
            grown[:n] = self._known[:n]
            self._known = grown
        for first, rows in self._scores(words, order):
            self._known[n + first : n + first + len(rows)] = rows
        self._places.update(zip(words, range(n, n + len(words))))

    def _sums(self, counted, order):
        """Scores and lengths summed over the words of each text of a block.

        Words of earlier blocks are forgotten if those of this one would not fit beside them. A text with more
        words than are ever remembered is a block of its own and is summed in parts.
        """
        every = set().union(*counted)
        if len(every) > MAX_CACHED:
            (words,) = counted
            times = np.fromiter(words.values(), np.float64, len(words))
            return [sum(times[i : i + len(rows)] @ rows for i, rows in self._scores(list(words), order))]
        new = every - self._places.keys()
        if len(self._places) + len(new) > MAX_CACHED:
            self.forget()
            new = every
        if new:
            self._learn(sorted(new), order)
        place = self._places.__getitem__
        return [
            np.fromiter(words.values(), np.float64, len(words))
            @ self._known[np.fromiter(map(place, words), np.int64, len(words))] for words in counted]

    def cross_entropy(self, texts, order):
        """(bits per character in each language, number of characters) of each text; no letters: NaN, 0."""
        bits, size = np.full((len(texts), len(self.languages)), np.nan), np.zeros(len(texts), np.int64)
        for first, counted in _blocks(texts) if self.languages else ():
            for i, sums in enumerate(self._sums(counted, order), first):
                if sums[-1]:
                    size[i] = round(sums[-1])
                    bits[i] = sums[:-1] / sums[-1]
        return bits, size

    def calibrate(self, texts, names, order, slack):
        """Per language the middle bits per character, and how far a text may lie above it.

        How far is ``slack`` times the excess that ``QUANTILE`` of the calibration texts with at least ``LONG``
        characters stay below, in the middle language by that excess, so neither a wrong label nor one badly
        labelled language moves it much; for shorter texts that limit grows with the root of the missing length. A
        language without calibration texts rejects nothing.

        Long texts vary by their content (repeats, passages in another language) and not by their length.
        """
        bits, size = self.cross_entropy(texts, order)
        names = np.array(names)
        self.limits = np.full((len(self.languages), 2), np.inf)
        usual = []
        for k, name in enumerate(self.languages):
            own = (names == name) & (size > 0)
            if own.any():
                b, long = bits[own, k], size[own] >= LONG
                self.limits[k, 0] = np.median(b[long]) if long.any() else np.median(b)
                if long.any():
                    usual.append(np.quantile(b[long] - self.limits[k, 0], QUANTILE))
        far = slack * max(LEAST_EXCESS, sorted(usual)[(len(usual) - 1) // 2] if usual else 0.0)
        self.limits[:, 1] = np.where(np.isfinite(self.limits[:, 0]), far, np.inf)

    def predict(self, texts, order):
        """(language, score, rejected) of each text."""
        bits, size = self.cross_entropy(texts, order)
        names, scores, rejected = [], [], []
        for b, n in zip(bits, size):
            if n == 0 or not self.languages:
                names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                continue
            k = int(b.argmin())
            gap = np.minimum((b - b[k]) * min(n, 50), 500.0)
            names.append(self.languages[k]), scores.append(float(1 / np.sum(np.exp2(-gap))))
            mean, far = self.limits[k] if self.limits is not None else (np.inf, np.inf)
            rejected.append(bool(b[k] - mean > far * max(1.0, (LONG / n) ** 0.5)))
        return names, scores, rejected


def held_out(ids):
    """Whether a row is kept out of training: crc32 of the id as text is divisible by 5."""
    return F.pmod(F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_sample(docs, ids, text, lang, config):
    """About ``sample_rows`` labelled rows of each language, the ones with the smallest hash of the id."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(ids)))
    rank = F.pmod(F.xxhash64(F.col(ids)), F.lit(1 << 30))
    counts = {r[lang]: r["n"] for r in usable.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = F.lit(False)
    for name, n in counts.items():
        share = min(1.0, config.sample_rows / n)
        picked = picked | ((F.col(lang) == name) & (rank < int(share * (1 << 30))))
    return usable.filter(picked).select(F.col(lang).alias("lang"), F.col(text).alias("text"), rank.alias("rank"))


def _counter(config):
    """Word counts of the rows of a task: (lang, calibration, word, n)."""

    def run(batches):
        counts = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(letter_runs(text))
        for lang, words in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                 pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    return run


def train(docs, ids="doc_id", text="text", lang="lang", config=LanguageConfig()):
    """Models of all languages of ``docs``, fitted and calibrated on the bounded sample of labelled rows.

    Word counts of the sample are summed by Spark; their number is bounded with the rows of the sample.
    """
    sample = training_sample(docs, ids, text, lang, config)
    held = F.pmod(F.col("rank"), F.lit(config.calibration)) == 0
    counts = sample.filter(~held).select("lang", "text").mapInArrow(
        _counter(config), "lang string, word string, n bigint")
    words_of = {}
    for batch in counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for name, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
            words_of.setdefault(name, Counter())[word] = n
    words_of = {name: Counter(dict(sorted(c.items()))) for name, c in words_of.items()}
    models = LanguageModels.fit(words_of, config.order)
    rows = sample.filter(held).select("lang", "text").toArrow()
    if models.languages:
        models.calibrate(rows.column("text").to_pylist(), rows.column("lang").to_pylist(), config.order, config.slack)
    models.forget()
    return models


_live = {}


def _shared(spark, models):
    """A function that gives the models inside a task; a worker keeps them, and its scores, between tasks."""
    arrays = (models.languages, models.hashes, models.probability, models.weight, models.limits)
    shared, key = spark.sparkContext.broadcast(arrays), uuid.uuid4().hex

    def load():
        if key not in _live:
            _live.clear()
            _live[key] = LanguageModels(*shared.value)
        return _live[key]

    return load


def _predictor(load, order, extra):
    def run(batches):
        models = load()
        for batch in batches:
            names, scores, rejected = models.predict(batch.column("_text").to_pylist(), order)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in extra]
                + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                [*extra, "lang_pred", "score", "rejected"])

    return run


def identify(docs, models, ids="doc_id", text="text", config=LanguageConfig()):
    """One row per row of ``docs``: (doc_id, lang_pred, score, rejected).

    The language whose model gives the fewest bits per character; ``score`` is its posterior over at most 50
    characters at that rate. Null texts and texts without a letter are "und" with score 0, rejected. Other
    rows are rejected if they are much less likely in their language than calibration texts of their
    length usually are. Very long texts are read whole, in parts. Equal texts have equal results; ties go to the first language by name. Without models (no
    labelled rows) all rows are "und". One scan, no shuffle; the models are bounded by the sample.
    """
    rows = docs.select(F.col(ids).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _predictor(_shared(docs.sparkSession, models), config.order, ["doc_id"]),
        f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs, models, text="text", config=LanguageConfig()):
    """The rows of ``docs`` whose text is not rejected, with all their columns; one scan, no shuffle."""
    load = _shared(docs.sparkSession, models)

    def run(batches):
        models = load()
        for batch in batches:
            place = batch.schema.names.index(text)
            _, _, rejected = models.predict(batch.column(place).to_pylist(), config.order)
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
