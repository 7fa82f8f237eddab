import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, ""),
    (4, None),
    (5, "Éa"),
    (None, "the quick brown fox jumps over the lazy dog again and again"),
    (6, "word " * 30_000),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, copies, a repeated row, and extra columns with names used inside."""
    rows = [(i, t, None if i == 5 else "en", "s", 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int, score int").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
