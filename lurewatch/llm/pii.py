"""Personal data: spans by fixed formats, and further spans chosen by boosted trees among broad candidates.

Everything is column expressions: regular expressions give matches and the pieces between them, lengths of
both give the places, and the trees are nested CASE expressions over the features of a candidate.
"""

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lurewatch.session import materialise

KINDS = ["email", "ip", "card", "phone"]

# The formats of the base spans, leftmost and non-overlapping per kind. Possessive quantifiers
# change no match (nothing follows that could need the characters back) and keep long runs linear. A run of
# address characters without "@" is tried once, at its start or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_PARTS = rf"^{BYTE}(?:\.{BYTE}){{3}}$"

#: Broad generators; their spans may overlap each other and the base spans.
GENERATORS = {
    "address": r"[^\s@]{1,64}@[^\s@]{1,255}",
    "dotted": r"(?<![0-9])[0-9]++(?:\.[0-9]++){2,}+",
    "number": r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,30}+",
}
CUE = r"(?i)(mail|contact|write|tel|phone|call|mobile|card|visa|account|ip|host|address)\W{0,3}$"
CONTEXT = 24
BLOCK = 256


@dataclass(frozen=True)
class PiiConfig:
    """The candidates of all documents train the trees; one document in five, by hash of the id, calibrates
    the threshold to ``precision``. ``sample_rows``, if set, bounds the documents instead (about as many). A candidate that is neither a base span nor
    refused counts as a negative of weight ``unknown``, since some are what the base formats miss; a leaf holds
    at least the share ``leaf`` of all weight, so a few of them get no leaf of their own."""

    sample_rows: int | None = None
    trees: int = 10
    depth: int = 3
    precision: float = 0.95
    unknown: float = 0.1
    leaf: float = 0.01
    seed: int = 5


def needed(text):
    """What a text must hold for a pattern to match at all; most texts are done with this."""
    digit = F.col("_digit")
    return {"email": F.contains(text, F.lit("@")), "address": F.contains(text, F.lit("@")),
            "phone": F.contains(text, F.lit("+")) & digit, "ip": digit, "card": digit, "dotted": digit, "number": digit}


SPANS = "array<struct<start:bigint,end:bigint,match:string>>"


def _matches(text, pattern, given):
    """array<struct<gap, match>>: each match and the length of what lies before it; none unless ``given``.

    Splitting by a pattern gives what lies between its matches.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    pairs = F.filter(pairs, lambda x: x["match"].isNotNull())
    pairs = F.transform(pairs, lambda x: F.struct(F.length(x["gap"]).cast("bigint").alias("gap"), x["match"].alias("match")))
    return F.when(given, pairs).otherwise(F.array().cast("array<struct<gap:bigint,match:string>>"))


def with_spans(df, text, patterns):
    """Add a column per entry of ``patterns``: array<struct<start, end, match>> of all matches, in code points.

    The matches are a column of their own, so their expressions, used several times after, run once.
    """
    given = needed(F.col(text))
    df = df.withColumns({f"_m{name}": _matches(F.col(text), p, given[name]) for name, p in patterns.items()})
    df = df.withColumns({f"_{name}": _placed(F.col(f"_m{name}")) for name in patterns})
    return df.drop(*[f"_m{name}" for name in patterns])


def _placed(pairs):
    """Places from lengths, added up in blocks: many matches in one text do not cost their square."""
    kind = SPANS

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK)),
        lambda b: F.aggregate(F.slice(pairs, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)), first, step))

    def join(acc, block):
        moved = F.transform(block["out"], lambda s: F.struct(
            (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["match"].alias("match")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    joined = F.flatten(F.aggregate(blocks, start, join)["out"])
    return F.when(F.size(pairs) > 0, joined).otherwise(F.array().cast(kind))


def digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number):
    """Whether a string of digits passes the Luhn check."""
    def value(i):
        d = F.substring(number, -i, 1).cast("int")
        return F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind):
    """The check of a match of ``kind`` beyond its pattern, for F.filter."""
    def check(span):
        match = span["match"]
        if kind == "ip":
            return match.rlike(IP_PARTS)
        if kind == "card":
            d = digits(match)
            return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
        if kind == "phone":
            return F.length(digits(match)).between(8, 15)
        return F.lit(True)

    return check


def with_base_spans(df, text):
    """Add ``_email``, ``_ip``, ``_card`` and ``_phone``: the base spans of each kind."""
    df = with_spans(df.withColumn("_digit", F.col(text).rlike("[0-9]")), text, PATTERNS)
    return df.withColumns({f"_{kind}": F.filter(f"_{kind}", _valid(kind)) for kind in KINDS})


FEATURES = [
    "chars", "digits", "letters", "blanks", "dashes", "dots", "brackets", "ats", "plus", "largest_part",
    "glued_before", "glued_after", "cue", "caps_before", "digits_before", "digits_after",
]


def _features(text, span):
    """The format of a candidate and what stands around it."""
    match = span["match"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)).cast("int"),
                         F.least(span["start"], F.lit(CONTEXT)).cast("int"))
    after = F.substring(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT))

    def count(part, pattern):
        return F.length(part) - F.length(F.regexp_replace(part, pattern, ""))

    parts = F.transform(F.split(match, r"\."), lambda p: F.least(F.length(p), F.lit(99)))
    values = [
        F.length(match), count(match, "[0-9]"), count(match, "[A-Za-z]"), count(match, r"\s"), count(match, "-"),
        count(match, r"\."), count(match, "[()]"), count(match, "@"), match.startswith("+").cast("int"),
        F.array_max(parts), before.rlike("[A-Za-z0-9]$").cast("int"), after.rlike("^[A-Za-z0-9]").cast("int"),
        before.rlike(CUE).cast("int"), count(before, "[A-Z]"), count(before, "[0-9]"), count(after, "[0-9]"),
    ]
    return F.array(*[v.cast("double") for v in values])


def _kind_of(span):
    n = F.length(digits(span["match"]))
    return (F.when(F.contains(span["match"], F.lit("@")), F.lit(0)).when(span["match"].rlike(r"^[0-9.]+$") & F.contains(span["match"], F.lit(".")), F.lit(1))
            .when((n >= 13) & ~span["match"].startswith("+"), F.lit(2)).otherwise(F.lit(3)))


def _refused(span, f):
    """Whether a candidate that is no base span cannot be one either: it is part of a longer word or number, has no
    four parts of at most 255, fails the Luhn check, or has too few or too many digits after a plus."""
    kind, match = _kind_of(span), span["match"]
    n = F.length(digits(match))
    glued = (f[FEATURES.index("glued_before")] > 0) | (f[FEATURES.index("glued_after")] > 0)
    wrong_phone = (kind == 3) & match.startswith("+") & ~n.between(8, 15)
    return glued | (kind == 1) | ((kind == 2) & (n >= 16)) | wrong_phone


def with_candidates(df, text):
    """Add ``_candidates``: array<struct<kind, start, end, base, overlaps, refused, f>> of all generators."""
    found = with_spans(df, text, GENERATORS)
    found = found.withColumn("_found", F.array_distinct(F.concat(*[f"_{name}" for name in GENERATORS])))
    known = F.concat(*[F.transform(f"_{kind}", lambda s: F.struct(s["start"], s["end"])) for kind in KINDS])
    found = found.withColumn("_known", known)
    found = found.withColumn("_found", F.transform("_found", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), _features(F.col(text), s).alias("f"))))
    candidate = lambda s: F.struct(
        _kind_of(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.exists("_known", lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"])).alias("base"),
        F.exists("_known", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])).alias("overlaps"),
        _refused(s, s["f"]).alias("refused"), s["f"].alias("f"))
    return found.withColumn("_candidates", F.transform("_found", candidate)).drop("_found", "_known")


_split = re.compile(r"If \(feature (\d+) <= ([-+0-9.eE]+)\)")
_leaf = re.compile(r"Predict: ([-+0-9.eE]+)")


def tree_expression(lines, f):
    """The value of one tree, of which ``lines`` is the description in depth-first order, as a CASE expression."""
    line = next(lines).strip()
    if leaf := _leaf.match(line):
        return F.lit(float(leaf[1]))
    feature, threshold = _split.match(line).groups()
    low = tree_expression(lines, f)
    next(lines)  # the line of the other branch
    return F.when(f[int(feature)] <= float(threshold), low).otherwise(tree_expression(lines, f))


def margin_score(model, f):
    """The probability that a fitted boosted model gives to the feature array ``f``."""
    trees = [t.toDebugString.splitlines()[1:] for t in model.trees]
    margin = sum((tree_expression(iter(t), f) * w for t, w in zip(trees, model.treeWeights)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def train(docs, ids="doc_id", text="text", config=PiiConfig()):
    """(model, threshold), or None where the rows hold not both base and other candidates.

    A candidate that is a base span is a positive example. Refused ones are negative, others weigh little, and
    those that overlap a base span are left out. The checks behind the base formats are no features, so the trees
    have to tell from format and context. The threshold lies in the middle between the lowest score from which
    on the calibration rows have the wanted precision, by weight, and the next score below; at one half at least,
    since where hardly anything is negative every score has that precision.
    """
    rank = F.pmod(F.xxhash64(F.col(ids)), F.lit(1 << 30))
    if config.sample_rows is not None:
        docs = docs.filter(rank < int(min(1.0, config.sample_rows / max(docs.count(), 1)) * (1 << 30)))
    given = docs.select(rank.alias("_rank"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # The outer form: for the plain one the optimizer filters by the array's size, and so computes it for all rows.
    rows = with_candidates(with_base_spans(given, "_text"), "_text").select("_rank", F.explode_outer("_candidates").alias("c")).filter("c IS NOT NULL AND (c.base OR NOT c.overlaps)")
    rows = materialise(rows.select((F.pmod(F.col("_rank"), F.lit(5)) == 0).alias("held"), F.col("c.base").cast("double").alias("label"),
                                  F.when(F.col("c.base") | F.col("c.refused"), 1.0).otherwise(config.unknown).alias("weight"), F.col("c.f").alias("f")), "pii-candidates")
    classes = {(r["held"], r["label"]) for r in rows.select("held", "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= classes:
        return None
    booster = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=config.trees, maxDepth=config.depth, minWeightFractionPerNode=config.leaf, seed=config.seed)
    model = booster.fit(rows.filter("not held").select("label", "weight", array_to_vector("f").alias("features")))
    score = F.floor(margin_score(model, F.col("f")) * 200)
    bins = rows.filter("held").groupBy(score.alias("bin")).agg(F.sum("label").alias("hits"), F.sum("weight").alias("n")).collect()
    threshold, hits, n = 1.1, 0.0, 0
    bins = sorted(bins, key=lambda r: -r["bin"])
    below = [r["bin"] for r in bins[1:]] + [-1]
    for r, lower in zip(bins, below):
        hits, n = hits + r["hits"], n + r["n"]
        if hits >= config.precision * n:
            threshold = max(0.5, (r["bin"] + lower + 1) / 400)
    return model, threshold


def find_pii(docs, trained, ids="doc_id", text="text"):
    """One row per row of ``docs``: (doc_id, n_email, n_ip, n_card, n_phone, spans).

    ``spans``: array<struct<kind, start, end, base>> by kind as in ``KINDS``, then place; base spans and
    those candidates that overlap none, are not refused and reach the threshold; added ones may overlap each other.
    Very long texts are read whole. Null and empty texts have no spans. Repeated rows
    keep rows of their own; null ids stay null; no rows, no result rows. Other columns are not looked at. One
    scan, no shuffle, no Python: spans, features and trees are expressions on the row.
    """
    df = docs.select(F.col(ids).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = with_base_spans(df, "_text")
    entry = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base"))
    base = F.concat(*[F.transform(f"_{kind}", entry(k)) for k, kind in enumerate(KINDS)])
    if trained is None:
        every = base
    else:
        model, threshold = trained
        df = with_candidates(df, "_text")
        chosen = F.filter("_candidates", lambda c: ~c["overlaps"] & ~c["refused"] & (margin_score(model, c["f"]) >= threshold))
        added = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(False).alias("base")))
        every = F.array_sort(F.array_distinct(F.concat(base, added)))
    sizes = {f"n_{kind}": F.size(f"_{kind}").cast("bigint") for kind in KINDS}
    return df.select("doc_id", *[v.alias(k) for k, v in sizes.items()], every.alias("spans"))


def span_list(found):
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(text, found, mask="[{}]"):
    """``text`` with every span replaced by its kind; overlapping spans are replaced together, as the first."""
    names = F.array(*[F.lit(mask.format(k.upper())) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(
            F.concat(acc["out"], gap, names[s["kind"]])).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
