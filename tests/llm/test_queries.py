"""The registered queries beside their SQL or a brute-force version, and the pipeline."""


import pytest

import check
import corpus_pipeline
import __spark_entry__ as entry
from lurewatch.llm import decontamination, language
from lurewatch.llm.oracles import ORACLES
from lurewatch.llm.queries import QUERIES
from tests.llm.test_dedup import near_by_hand


@pytest.fixture(scope="module")
def db(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, sf, name):
    assert check.compare(spark, db, sf, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline"}))
def test_one_row_per_input_row(spark, db, sf, name):
    rows = entry.queries()[name](spark, sf).toArrow()
    if name == "op2_best_fit_packing":
        rows = rows.filter(rows.column("piece").to_numpy() == 0)
    table = {"op4_chat_formatting": "(select distinct conv_id from conversations union select -1)", "op8_html_extraction": "pages"}
    assert rows.num_rows == db.execute(f"select count(*) from {table.get(name, 'documents')}").fetchone()[0]


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_pipeline_against_brute_force(spark, db, sf):
    """Each stage anew in plain Python, on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = language.train(docs)
    rows = docs.toArrow().to_pylist()
    _, _, gone = models.predict([r["text"] for r in rows], language.LanguageConfig().order)
    rows = [r for r, out in zip(rows, gone) if not out]
    best = {}
    for r in rows:
        best[r["text"]] = max(best.get(r["text"], r["doc_id"]), r["doc_id"])
    rows = [r for r in rows if best[r["text"]] == r["doc_id"]]
    roots = near_by_hand([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if roots[r["doc_id"]][1] == r["doc_id"]]
    items = db.execute("select item_id, text from benchmark").fetchall()
    windows = {w for _, t in items for w in decontamination.windows(decontamination.alnum_words(t))}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = decontamination.alnum_words(text)
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    rows = [r for r in rows if clean(r["text"])]
    packed = corpus_pipeline.run(spark, sf).toArrow().to_pylist()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}
    sums = {}
    for r in packed:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert max(sums.values()) <= 1024


def test_stages_return_documents(spark, awkward, nothing, sf):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == awkward.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
