"""The audit of sources and its perfect hashes against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lurewatch.llm import divergence as D
from lurewatch.llm.perfect_hash import PerfectHash

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def audit_by_hand(rows, config):
    rows = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts = Counter(), {}
        for _, source, terms in (r for r in rows if r[0] == lang):
            docs.update(set(terms))
            counts.setdefault(source, Counter()).update(terms)
        kept = [t for t, n in docs.items() if n >= config.min_docs]

        def share(counter):
            n = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // n for t in kept}

        shares, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s, p in shares.items():
            pairs = [(-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o.encode()) for o, q in shares.items() if o != s]
            found = [(-((p[t] - whole[t]) ** 2 // (p[t] + whole[t])), t.encode()) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[: config.top])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


def texts(n, seed=2):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "xyz", "ß", "Q", "日本")]
    out = []
    for i in range(n):
        lang = ["en", "de", None, "rare"][min(3, int(rng.integers(0, 9)) // 3 if i % 40 else 3)]
        source = [None, "s1", "s2", "s3", "s4"][int(rng.integers(0, 5))] if rng.random() < 0.6 else "hot"
        weights = np.arange(1, len(words) + 1) ** -1.0
        text = " ".join(rng.choice(words, int(rng.integers(0, 25)), p=weights / weights.sum()))
        out.append((lang, source, text if rng.random() > 0.05 else None))
    out += [("en", "only", ""), ("en", "digits", "12 34 5"), ("xx", "alone", "one"), ("en", "s1", "A1b_C-dÉ " * 20_000)]
    return out + out[:5]


@pytest.mark.parametrize("config", [
    D.AuditConfig(), D.AuditConfig(min_docs=2, top=3, shard_bytes=64, pass_bytes=400, slots=8, block=4, pack=2),
    D.AuditConfig(min_docs=10_000),
])
def test_audit_against_brute_force(spark, config):
    rows = texts(200)
    docs = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "lang string, source string, text string, n int, term string, shard int")
    got = D.audit_sources(docs.repartition(4), config=config).collect()
    assert sorted(tuple(r) for r in got) == audit_by_hand(rows, config)
    assert D.audit_sources(docs.limit(0), config=config).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=12), max_size=200), st.lists(st.binary(max_size=3), max_size=50))
def test_perfect_hash(keys, others):
    made = PerfectHash.build(sorted(keys))
    assert sorted(made.slots(sorted(keys)).tolist()) == list(range(len(keys)))
    others = [o for o in others if o not in keys]
    assert (made.slots(others) == -1).all()
    assert [made.key(i) for i in made.slots(sorted(keys))] == sorted(keys)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**13), min_size=1, max_size=20), st.integers(1, 10**13))
def test_shares_are_exact(counts, more):
    total = sum(counts) + 2 * len(counts) + more
    total = min(total, D.MOST_WORDS)
    assert D.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]
