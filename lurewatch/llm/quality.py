"""Document quality from supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lurewatch.llm.language import held_out
from lurewatch.llm.words import gram_hashes, mixed, word_hashes

CHAR_GRAMS = (3, 4)
#: Bytes of a text that are turned into features at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class QualityConfig:
    """``sample_rows`` bounds the labelled rows of a fit (about as many, the same ones in each run)."""

    buckets_log2: int = 16
    dim: int = 8
    epochs: int = 8
    rate: float = 2.0
    sample_rows: int = 4000
    cut: float = 0.3
    seed: int = 11


def features(text, buckets_log2):
    """Blocks of bucket numbers of the words, word pairs and character n-grams of a text; none for null.

    Character n-grams are runs of bytes of the whole text, so blanks mark the borders of words.
    """
    data = text.encode("utf-8", "surrogatepass") if text else b""
    shift = np.uint64(64 - buckets_log2)
    words = word_hashes(data.split())
    if len(words):
        yield mixed(words.copy()) >> shift
        if len(words) > 1:
            pairs = gram_hashes(words, 2)
            # A pair of equal words is one feature, whatever the word is.
            pairs[words[1:] == words[:-1]] = np.uint64(1)
            yield mixed(pairs) >> shift
    for start in range(0, len(data), BLOCK):
        codes = np.frombuffer(data[start : start + BLOCK + max(CHAR_GRAMS) - 1], np.uint8).astype(np.uint64)
        for n in CHAR_GRAMS:
            count = min(BLOCK, len(codes) - n + 1)
            if count > 0:
                run = np.full(count, n, np.uint64)
                for i in range(n):
                    run <<= np.uint64(8)
                    run |= codes[i : i + count]
                yield mixed(run) >> shift


class QualityModel:
    """Embeddings of the buckets, averaged over a document, and a softmax over the two labels."""

    def __init__(self, vectors, output, bias):
        self.vectors, self.output, self.bias = vectors, output, bias

    def logits(self):
        """What one feature adds to the log odds of label 1, before averaging; and the constant."""
        direction = self.output[:, 1] - self.output[:, 0]
        return (self.vectors @ direction).astype(np.float32), float(self.bias[1] - self.bias[0])

    @classmethod
    def fit(cls, texts, labels, config):
        random = np.random.default_rng(config.seed)
        size = 1 << config.buckets_log2
        vectors = random.uniform(-1 / config.dim, 1 / config.dim, (size, config.dim)).astype(np.float32)
        output, bias = np.zeros((config.dim, 2), np.float32), np.zeros(2, np.float32)
        rows = []
        for text, label in zip(texts, labels):
            parts = list(features(text, config.buckets_log2))
            if parts:
                ids, n = np.unique(np.concatenate(parts), return_counts=True)
                rows.append((ids.astype(np.int64), (n / n.sum()).astype(np.float32), int(label)))
        steps, done = max(1, config.epochs * len(rows)), 0
        for _ in range(config.epochs):
            for k in random.permutation(len(rows)).tolist():
                rate = config.rate * (1 - done / steps)
                done += 1
                ids, share, label = rows[k]
                hidden = share @ vectors[ids]
                z = hidden @ output + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[label] -= 1
                back = output @ p
                output -= rate * np.outer(hidden, p)
                bias -= 0.1 * rate * p
                vectors[ids] -= (rate * share)[:, None] * back * min(len(ids), 50)
        return cls(vectors, output, bias)


def labelled_sample(docs, labels, ids, text, label, config):
    """About ``sample_rows`` labelled rows that are not held out: those with the smallest hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(ids))).select(ids, F.col(label).alias("_label"))
    known = known.groupBy(ids).agg(F.max("_label").alias("_label"))
    n = known.count()
    rank = F.pmod(F.xxhash64(F.col(ids)), F.lit(1 << 30))
    share = min(1.0, config.sample_rows / max(n, 1))
    known = known.filter(rank < int(share * (1 << 30)))
    return docs.select(F.col(ids), F.col(text).alias("_text")).join(F.broadcast(known), ids).select("_text", "_label")


def train(docs, labels, ids="doc_id", text="text", label="quality", config=QualityConfig()):
    """The model fitted on the bounded sample; the sample is small, so it is joined as a broadcast table."""
    rows = labelled_sample(docs, labels, ids, text, label, config).orderBy("_label", F.xxhash64("_text")).toArrow()
    return QualityModel.fit(rows.column("_text").to_pylist(), rows.column("_label").to_pylist(), config)


def _scorer(shared, config):
    def run(batches):
        weights, constant = shared.value
        for batch in batches:
            scores = []
            for text in batch.column("_text").to_pylist():
                total, n = 0.0, 0
                for part in features(text, config.buckets_log2):
                    total += float(weights[part].sum(dtype=np.float64))
                    n += len(part)
                z = constant + (total / n if n else 0.0)
                scores.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= config.cut) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return run


def score_quality(docs, model, ids="doc_id", text="text", config=QualityConfig()):
    """One row per row of ``docs``: (doc_id, score, predicted).

    ``score`` is the probability of label 1 from the whole text: the mean of its features' vectors through the
    softmax. Null and empty texts have no features and get the constant of the model. Equal texts get equal
    scores; repeated rows keep rows of their own; a model fitted on no rows gives 0.5. Other columns are not
    looked at. One scan, no shuffle; the broadcast weights have a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.logits())
    rows = docs.select(F.col(ids).alias("doc_id"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(shared, config), f"doc_id {kind}, score double, predicted int")
