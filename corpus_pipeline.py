"""The corpus pipeline: five stages from raw documents to packed sequences."""

import uuid

import public_tokenizers
from lurewatch.llm import decontamination, exact_dedup, language, near_dedup, packing
from lurewatch.session import checkpoint_root


def identify_language(spark, docs, sf_dir):
    """Documents whose language is recognised; those without letters or far from every language go."""
    return language.keep_identified(docs, language.train(docs))


def drop_exact_copies(spark, docs, sf_dir):
    """One document of each text: the one with the largest id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def drop_near_copies(spark, docs, sf_dir):
    """One document of each component of near duplicates: the one with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_contaminated(docs, benchmark)


def pack_documents(spark, docs, sf_dir):
    """The pieces of the remaining documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

# A trained language model and a packing order have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; the result of every stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{checkpoint_root(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
