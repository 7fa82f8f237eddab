"""Decontamination, packing, language, licences, quality and personal data on small tables."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lurewatch.llm import decontamination, language, licenses, packing, pii, quality

BPE = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return df.toArrow().to_pylist()


# decontamination

def hits_by_hand(text, items, size=10):
    words = decontamination.alnum_words(text)
    hit, ids = set(), set()
    for item, body in items:
        for window in decontamination.windows(decontamination.alnum_words(body), size):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


def test_automaton_of_words_near_its_limit():
    """Its memory is a tenth of a gigabyte for a megabyte of items: no node more than the words of the windows."""
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{j}" for j in rng.integers(0, 5000, 60))) for i in range(300)]
    automaton = decontamination.WindowAutomaton(items)
    assert automaton.automaton.get_stats()["nodes_count"] <= 300 * 51 * 10 + 1
    text = f"zzz {items[7][1]} w1 zzz " + items[9][1][:40]
    spans, ids = automaton.scan(decontamination.alnum_words(text))
    n, hit, wanted = hits_by_hand(text, items)
    assert sum(e - s for s, e in spans) == hit and sorted(ids) == wanted


ITEMS = [(3, "a b c d e f g h i j k l"), (20, "Short one"), (1, "é b é"), (7, ""), (8, None), (9, "short one")]


@pytest.mark.parametrize("limit", [4_000_000, 12])
def test_contamination(spark, limit):
    texts = ["x A b c d e f g h i j! k l y short ONE", "a b c d e f g h i k", "é b é b é", "short", "", None, "short one short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = rows_of(decontamination.find_contamination(docs, benchmark, automaton_bytes=limit))
    assert len(found) == len(texts)
    for r in found:
        n, hit, ids = hits_by_hand(texts[r["doc_id"]], ITEMS)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["n_items"]) == (n, hit, ids, len(ids))
        assert r["items_sha256"] == sha256(",".join(ids).encode()).hexdigest() and r["contaminated"] == (hit > 0)
    clean = rows_of(decontamination.drop_contaminated(docs, benchmark, automaton_bytes=limit))
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in found if not r["contaminated"]}


def test_contamination_awkward(awkward, nothing, spark):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps")], "item_id bigint, text string")
    found = rows_of(decontamination.find_contamination(awkward, benchmark))
    assert sum(r["contaminated"] for r in found) == 4 and len(found) == 8
    assert decontamination.find_contamination(nothing, benchmark).count() == 0
    assert decontamination.find_contamination(awkward, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontamination.drop_contaminated(awkward, benchmark).columns == awkward.columns


# packing

ODD = ["a  b", "a\n  b", " a b ", "x \n y", "it's 's \t\t x", "", "   ", "<|endoftext|> x", "é\r\n\r\n z", "a\x1c b", "漢字 emoji 🙂"]


def test_tokens_are_those_of_the_library(spark, sf):
    tokens, library = packing.Tokens(BPE), Tokenizer.from_file(BPE)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").toArrow().to_pylist()]
    for text in ODD + texts:
        assert tokens(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u00a0", " \n"])
@pytest.mark.parametrize("form", ["{}", "a{}", "{}a", "a{}b"])
def test_tokens_of_very_long_white_space(space, form):
    tokens, library = packing.Tokens(BPE), Tokenizer.from_file(BPE)
    for n in (1_000_000, packing.LONG_SPACE, packing.LONG_SPACE - 1):
        text = form.format(space * (n // len(space)))
        assert tokens(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_very_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000 + "b"), (3, "x")], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, BPE).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    library = Tokenizer.from_file(BPE)
    assert {r["doc_id"]: r["n"] for r in rows} == {
        r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}


@pytest.mark.parametrize("n,points", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut_points(n, points):
    assert packing.cut_points(n) == points


def test_sum_of_squares_places_each_item_at_the_least_sum():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 33, 400)
    bins, offsets = packing.sum_of_squares(lengths, 32)
    used, gaps = {}, {}
    for i in np.argsort(-lengths, kind="stable"):
        n, b = int(lengths[i]), int(bins[i])

        def total(g):
            after = [x for k, x in gaps.items() if k != g] + [gaps[g] - n] if g is not None else [*gaps.values(), 32 - n]
            counts = np.bincount([x for x in after if x > 0], minlength=33)
            return int((counts**2).sum())

        room = {x: k for k, x in gaps.items() if x >= n}
        if room:
            assert total(b) == min(total(k) for k in room.values())
        else:
            assert b not in gaps
        assert offsets[i] == used.get(b, 0)
        used[b] = used.get(b, 0) + n
        gaps[b] = 32 - used[b]
    assert min(gaps.values()) >= 0 and len(gaps) <= -(-lengths.sum() // 32) * 1.05


@pytest.mark.parametrize("group_rows", [100_000, 3])
def test_packing(awkward, nothing, group_rows):
    library = Tokenizer.from_file(BPE)
    rows = rows_of(packing.pack_documents(awkward, BPE, group_rows=group_rows))
    pieces = {}
    for r in rows:
        pieces.setdefault(r["sequence_id"], []).append(r)
    for packed in pieces.values():
        at = 0
        for r in sorted(packed, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    long = sorted((r for r in rows if r["doc_id"] == 6), key=lambda r: r["piece"])
    ids = library.encode("word " * 30_000, add_special_tokens=False).ids + [2]
    assert sum(r["length"] for r in long) == len(ids) and all(r["length"] == 1024 for r in long[1:])
    for r in long:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack_documents(nothing, BPE).count() == 0


# language

def kn_by_hand(words, order, gram):
    """Interpolated Kneser-Ney of the last character of ``gram`` by the definition, from all bordered words."""
    from collections import Counter

    grams = {n: Counter() for n in range(1, order + 1)}
    for word, times in words.items():
        marked = f" {word} "
        for i in range(1, len(marked)):
            for n in range(1, order + 1):
                if i + 1 >= n:
                    grams[n][marked[i + 1 - n : i + 1]] += times
    counts = dict(grams)
    for n in range(order - 1, 0, -1):
        counts[n] = Counter({g: c if g[0] == " " and n > 1 else len({h[0] for h in grams[n + 1] if h[1:] == g}) or c
                             for g, c in grams[n].items()})

    def p(g):
        n, d = len(g), language.DISCOUNT
        if n == 1:
            total = sum(counts[1].values())
            c = counts[1].get(g, 0)
            return (1 - language.UNSEEN) * (max(c - d, 0) / total + d / total) if c else language.UNSEEN
        same = {h: c for h, c in counts[n].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[1:])

    return p(gram)


def test_kneser_ney_against_the_definition():
    words = {"banana": 3, "band": 1, "nab": 2, "é": 1}
    model = language.LanguageModels.fit({"x": words}, 3)
    for word in ("banana", "bad", "zap", "é", "nnn"):
        marked = f" {word} "
        cost = -sum(np.log2(kn_by_hand(words, 3, marked[max(0, i - 2) : i + 1])) for i in range(1, len(marked)))
        assert model._score_words([word], 3)[0, 0] == pytest.approx(cost, rel=1e-5)
    mass = sum(kn_by_hand(words, 3, "an" + c) for c in "abdné ")
    assert mass == pytest.approx(1, abs=1e-4)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = language.train(docs)
    found = language.identify(docs, models).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = rows_of(found.filter(language.held_out(F.col("doc_id"))))
    right = [r["lang"] == r["lang_pred"] for r in rows]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert not any(r["rejected"] for r in rows if re.search(r"[^\W\d_]", r["text"] or ""))


def test_language_awkward(awkward, nothing, spark):
    models = language.train(awkward)
    rows = rows_of(language.identify(awkward, models))
    assert len(rows) == 8 and all(r["lang_pred"] == "und" and r["rejected"] and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4))
    assert {r["lang_pred"] for r in rows if r["doc_id"] not in (3, 4)} == {"en"}
    assert language.identify(nothing, models).count() == 0
    none = language.train(nothing)
    assert {r["lang_pred"] for r in rows_of(language.identify(awkward, none))} == {"und"}
    assert language.keep_identified(awkward, models).columns == awkward.columns


def test_far_texts_are_rejected(spark):
    english = "the cat sat on the mat and then it ran to the other house with a small bird in the garden "
    train = spark.createDataFrame([(i, english * (1 + i % 3), "en") for i in range(60)], "doc_id bigint, text string, lang string")
    models = language.train(train)
    texts = [(1, english), (2, "zxq vwj kqx jjz qqv wxz zzk qxj vvq kzw " * 5), (3, "12 34 -")]
    rows = {r["doc_id"]: r for r in rows_of(language.identify(spark.createDataFrame(texts, "doc_id bigint, text string"), models))}
    assert not rows[1]["rejected"] and rows[2]["rejected"] and rows[3]["lang_pred"] == "und"


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_more_words_than_are_remembered(monkeypatch, cap):
    model = language.LanguageModels.fit({"x": {"banana": 3, "band": 1}, "y": {"nab": 2, "é": 1}}, 3)
    texts = ["banana band", "", "a b c d e f g h i j a", None, "nab band zap", "banana band", "k l m n o p q"]
    bits, size = model.cross_entropy(texts, 3)
    monkeypatch.setattr(language, "MAX_CACHED", cap)
    monkeypatch.setattr(language, "PART_WORDS", 2, raising=False)
    model.forget()
    for part in (["band"], texts, ["nab"], texts):
        found, sizes = model.cross_entropy(part, 3)
        assert len(model._places) <= cap
    assert np.allclose(found, bits, equal_nan=True) and list(sizes) == list(size)
    assert found[0].tolist() == found[5].tolist()


def test_held_out_rule(spark):
    ids = spark.createDataFrame([(i,) for i in range(-5, 50)], "doc_id bigint")
    for r in rows_of(ids.select("doc_id", language.held_out(F.col("doc_id")).alias("h"))):
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_wrong_labels_do_not_open_the_rejection():
    """One long text under another language's label leaves the limit where it is."""
    rng = np.random.default_rng(4)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(200))
    alphabets = {"a": "abcdefg", "b": "hijklmn", "c": "opqrstu"}
    words = {k: Counter(language.letter_runs(" ".join(make(v) for _ in range(20)))) for k, v in alphabets.items()}
    limits = []
    for wrong in ([], [(make("abcdefg"), "b")]):
        models = language.LanguageModels.fit(words, 3)
        rows = [(make(v), k) for k, v in alphabets.items() for _ in range(60)] + wrong
        models.calibrate([t for t, _ in rows], [n for _, n in rows], 3, 4.0)
        limits.append(models.limits)
        far = models.predict([make("vwxyzäö") for _ in range(10)] + [make(v) for v in alphabets.values()], 3)[2]
        assert far == [True] * 10 + [False] * 3
    assert np.allclose(*limits, atol=0.05)


# licences

def test_licences(spark):
    texts = [
        "Under the MIT License, and MIT license. GNU General Public License!",
        "cc-by CC BY apache  license gnu general public", "", None, "mit", "mit licence",
        "x y Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense and/or sell copies of the Software z",
        "mit license " * 500,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in rows_of(licenses.scan_licenses(docs.unionByName(docs)))}
    assert licenses.scan_licenses(docs.unionByName(docs)).count() == 16
    for i, text in enumerate(texts):
        words = [w.decode() for w in licenses.alnum_words(text)]
        starts, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            for j in range(len(words) - len(p) + 1):
                if words[j : j + len(p)] == p:
                    starts.append(j)
                    labels.add(label)
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(starts))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(labels))
    assert rows[6]["labels"] == "mit" and rows[6]["base_labels"] == "" and 0.6 <= rows[6]["score"] <= 1
    assert rows[0]["score"] == 1 and rows[2]["score"] == 0


def test_broken_up_notice(spark):
    """A word put in after every three and two words leaves runs with one and two votes, and stray pairs lie around."""
    notice = dict(licenses.NOTICES)["mit"].split()
    broken, at, step = [], 0, 3
    while at < len(notice):
        broken += notice[at : at + step] + ["zzz"]
        at, step = at + step, 5 - step
    stray = "the software of the to use in any person " * 400
    texts = [" ".join(broken), stray + " ".join(notice) + " " + stray, stray, " ".join(notice[:12])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = {r["doc_id"]: r["labels"] for r in rows_of(licenses.scan_licenses(docs))}
    assert labels == {0: "mit", 1: "mit", 2: "", 3: ""}


def test_licences_awkward(awkward, nothing):
    assert licenses.scan_licenses(awkward).count() == 8
    assert licenses.scan_licenses(nothing).count() == 0


# quality

def test_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    rows = rows_of(quality.score_quality(docs, model).join(labels, "doc_id"))
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    wins = np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good])
    assert wins > 0.9 and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_awkward(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (6, 0), (6, 0)], "doc_id bigint, quality int")
    rows = rows_of(quality.score_quality(awkward, quality.train(awkward, labels)))
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    untrained = quality.train(awkward, labels.limit(0))
    assert {r["score"] for r in rows_of(quality.score_quality(awkward, untrained))} == {0.5}
    assert quality.score_quality(nothing, untrained).count() == 0


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = "some words, éé and more words " * 20
    whole = np.sort(np.concatenate(list(quality.features(text, 12))))
    monkeypatch.setattr(quality, "BLOCK", 37)
    assert np.array_equal(whole, np.sort(np.concatenate(list(quality.features(text, 12)))))


# personal data

def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def base_by_hand(text):
    only = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


PII = [
    "é🙂 write a.b+c@x.example.com, a@b.c_d@e.f; x@y a@b..c a@@b.c @x.y a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.01 1.2.3 999.1.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111111 5", "+1 (555) 010-0199. +49 30 123 +1234567 +123456789012345678 ++1 2-3(4)5.6 7 8 ",
    "", None, "9 " * 3000 + "a" * 5000 + "1" * 9000, "1.1.1.1 " * 600 + "x" * 30 + " a@b.cd " * 300, "@", "+", "5" * 16, "+1 ((((((((((((((((((((((((", "a@b.c" * 40,
]


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(PII)), "doc_id bigint, text string").repartition(3)
    rows = rows_of(pii.find_pii(docs, None).withColumn("list", pii.span_list("spans")))
    assert len(rows) == len(PII)
    for r in rows:
        expected = base_by_hand(PII[r["doc_id"]] or "")
        assert r["list"] == ",".join(expected)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(e.startswith(k + ":") for e in expected) for k in pii.KINDS]


def test_trees_as_expressions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(100).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn(
        "text", F.concat(F.lit("tel 1.2.3.4 or 12.34 at +1 (555) 010-0199, 2024-01-02 11 22, "), F.col("text"))))
    model, threshold = pii.train(docs)
    assert 0 <= threshold <= 1.1
    rows = pii.with_candidates(pii.with_base_spans(docs.select(F.col("text").alias("_text")), "_text"), "_text")
    rows = rows.select(F.explode("_candidates.f").alias("f")).distinct()
    from pyspark.ml.functions import array_to_vector, vector_to_array

    both = model.transform(rows.select("f", array_to_vector("f").alias("features"))).select(
        pii.margin_score(model, F.col("f")).alias("mine"), vector_to_array("probability")[1].alias("theirs"))
    for r in rows_of(both):
        assert r["mine"] == pytest.approx(r["theirs"], abs=1e-9)


def test_added_spans_leave_base_spans(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call 555 010 0199 22 or a@b.cd x@y")], "doc_id bigint, text string")
    monkeypatch.setattr(pii, "margin_score", lambda model, f: F.lit(1.0))
    row = rows_of(pii.find_pii(docs, (None, 0.5)).withColumn("list", pii.span_list("spans")))[0]
    assert row["list"] == "email:24:30,email:31:34,phone:5:20" and row["n_email"] == 1 and row["n_phone"] == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4!"), (2, ""), (3, "x")], "doc_id bigint, text string")
    found = pii.find_pii(docs, None).join(docs, "doc_id").select("doc_id", pii.redact("text", F.col("spans")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in rows_of(found)} == {1: "é [EMAIL], [IP]!", 2: "", 3: "x"}


def test_pii_awkward(awkward, nothing):
    assert pii.train(awkward) is None and pii.train(nothing) is None
    assert pii.find_pii(awkward, None).count() == 8
    assert pii.find_pii(nothing, None).count() == 0


def test_pii_runs_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = pii.find_pii(docs, pii.train(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_trees_add_spans_beyond_the_base_formats(spark):
    """Local phone numbers and addresses without a dot are added; parts of words and failed checks are not."""
    rng = np.random.default_rng(2)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    texts = []
    for i in range(400):
        parts = [f"write to u{i}@example.com", f"call +49 30 {digit(7)}", f"from 10.1.{i % 250}.7", f"token=a{digit(9)}f{digit(7)}b",
                 "some words", "other words here", f"room {digit(3)}", f"phone +1 (212) 555-{digit(4)}"]
        texts.append(". ".join(rng.permutation(parts)[: int(rng.integers(1, 6))]) + ".")
    new = {1000: "please call (030) 555-12345 today", 1001: "mail root@localhost please", 1002: "token=ab1234567890cd",
           1003: "host 300.2.3.4.5 and version 1.2.3"}
    docs = spark.createDataFrame(list(enumerate(texts)) + list(new.items()), "doc_id bigint, text string")
    trained = pii.train(docs)
    assert trained is not None
    found = {r["doc_id"]: [s for s in r["spans"] if not s["base"]] for r in rows_of(pii.find_pii(docs, trained))}
    added = {i: [new[i][s["start"]:s["end"]] for s in found[i]] for i in new}
    assert added == {1000: ["(030) 555-12345"], 1001: ["root@localhost"], 1002: [], 1003: []}


def test_personal_data_is_learned_from_all_documents(spark, monkeypatch):
    from lurewatch.llm import pii

    counted, kept = [], pii.materialise
    monkeypatch.setattr(pii, "materialise", lambda df, *a: counted.append(kept(df, *a)) or counted[-1])
    docs = spark.range(24_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN concat('mail a', id, '@b.org') ELSE 'x 1234567 y' END AS text")
    assert pii.train(docs) is not None
    assert counted[0].filter("label = 1").count() == 12_000 and counted[0].filter("label = 0").count() == 12_000
