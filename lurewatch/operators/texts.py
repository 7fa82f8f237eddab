"""Text operators: cleaning, tokens, vocabulary, tf-idf in long form and as vectors."""

from dataclasses import dataclass, field

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window
from pyspark.sql import functions as F

from lurewatch import constants as K
from lurewatch.functions import strings as S
from lurewatch.functions import text as T


def clean_text(df, text="text"):
    """Drop rows whose text is missing or only white space."""
    return df.filter(F.col(text).isNotNull() & ~S.is_blank(F.col(text)))


def require_columns(df, *names):
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


@dataclass(frozen=True)
class TextConfig:
    """Settings of the vectoriser."""

    max_features: int = K.MAX_FEATURES
    min_df: int = K.MIN_DF
    max_df: float = K.MAX_DF
    stop_words: list = field(default_factory=lambda: list(K.ENGLISH_STOP_WORDS))


def with_terms(df, text="text", terms="terms", config=TextConfig()):
    """Add the uni- and bigrams of the text, without stop words. One projection, no shuffle."""
    words = T.without_stop_words(T.tokens(F.coalesce(F.col(text), F.lit(""))), config.stop_words)
    return df.withColumn("_words", words).withColumn(terms, T.ngrams(F.col("_words"))).drop("_words")


def document_frequencies(df, text="text", config=TextConfig()):
    """(term, df, tf): documents that hold a term and its total count.

    Terms are sorted inside their row and each is paired with the one before it, so a term opens a run
    exactly once per document: one aggregation gives both counts. The only shuffle is on the terms, after
    partial sums on the map side. (The outer form of explode is used throughout this module: for the plain
    one the optimizer adds a filter on the array's size, which computes the array twice.)
    """
    ordered = with_terms(df, text, config=config).select(F.sort_array("terms").alias("s"))
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.col("s"))
    pairs = ordered.select(F.explode_outer(F.arrays_zip(F.col("s").alias("term"), shifted.alias("before"))).alias("p"))
    rows = pairs.select("p.term", "p.before").filter(F.col("term").isNotNull())
    opens = ~F.col("term").eqNullSafe(F.col("before"))
    return rows.groupBy("term").agg(F.count_if(opens).alias("df"), F.count(F.lit(1)).alias("tf"))


def select_vocabulary(frequencies, n_docs, config=TextConfig()):
    """The ``max_features`` most frequent terms within the document-frequency bounds; ties by term."""
    kept = frequencies.filter((F.col("df") >= config.min_df) & (F.col("df") <= F.lit(config.max_df * n_docs)))
    return kept.orderBy(F.desc("tf"), "term").limit(config.max_features)


def fit_vocabulary(df, text="text", config=TextConfig()):
    """(term, df, tf, idf) of the fitted vocabulary. At most ``max_features`` rows."""
    n_docs = df.count()
    vocabulary = select_vocabulary(document_frequencies(df, text, config), n_docs, config)
    return vocabulary.withColumn("idf", T.smooth_idf(F.lit(n_docs), F.col("df")))


class TextVectorizer:
    """A fitted vocabulary as Spark ML stages; a row is vectorised where it lies."""

    def __init__(self, terms, idf, config=TextConfig()):
        self.config, self.terms, self.idf = config, list(terms), list(idf)

    @classmethod
    def fit(cls, df, text="text", config=TextConfig()):
        # max_features bounds the rows that reach the driver.
        rows = fit_vocabulary(df, text, config).orderBy("term").collect()
        if not rows:
            raise ValueError("the vocabulary is empty; lower min_df or raise max_df")
        return cls([r["term"] for r in rows], [r["idf"] for r in rows], config)

    def stages(self, features="features"):
        return [
            CountVectorizerModel.from_vocabulary(self.terms, inputCol="terms", outputCol="_counts"),
            ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=features),
        ]

    def transform(self, df, text="text", features="features"):
        out = with_terms(df, text, config=self.config)
        for stage in self.stages(features):
            out = stage.transform(out)
        return out.drop("terms", "_counts", "_weighted")

    def long_form(self, df, ids="doc_id", text="text", normalise=True):
        """(id, term, tf, tfidf) of the known terms of every document. A row opens up where it lies: no shuffle."""
        out = with_terms(df.select(ids, text), text, config=self.config)
        for stage in self.stages():
            out = stage.transform(out)
        counts, weights = (F.unwrap_udt(c) for c in ("_counts", "features" if normalise else "_weighted"))
        # Both vectors hold the same positions.
        entries = F.arrays_zip(positions(counts).alias("i"), counts["values"].alias("tf"), weights["values"].alias("w"))
        # One literal that is split once when the plan is made; terms hold no control characters.
        terms = F.split(F.lit("\x01".join(self.terms)), "\x01")
        return (
            out.select(ids, F.explode_outer(entries).alias("e"))
            .filter(F.col("e.tf") > 0)
            .select(ids, F.get(terms, F.col("e.i")).alias("term"), F.col("e.tf").cast("int").alias("tf"),
                    F.col("e.w").alias("tfidf"))
        )


def positions(vector):
    """Positions of the entries of an unwrapped vector; a dense one lists none."""
    return F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))


def tfidf_joined(df, vocabulary, ids="doc_id", text="text", config=TextConfig(), normalise=True):
    """The long form for a vocabulary (term, idf) of any size, by a join on the term.

    Unknown terms leave with the join, and only what is left is shuffled, once, by document: rows with one id are one
    document. That is the only group that meets in one task."""
    exploded = with_terms(df, text, config=config).select(ids, F.explode_outer("terms").alias("term"))
    known = exploded.join(vocabulary.select("term", "idf"), "term").repartition(F.col(ids))
    tf = known.groupBy(ids, "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    weighted = tf.select(ids, "term", F.col("tf").cast("int").alias("tf"), (F.col("tf") * F.col("idf")).alias("tfidf"))
    if not normalise:
        return weighted
    norm = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy(ids)))
    return weighted.withColumn("tfidf", F.try_divide("tfidf", norm))
