"""For each registered query the same result as DuckDB SQL over the same tables."""

from lurewatch import constants as K
from lurewatch.catalog import inputs as I
from lurewatch.functions import strings as S

SPACE = S.space_class()
DIGIT = S.digit_class()


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def listed(values):
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def r6(name, alias=None):
    return f"round({name}, 6) AS {alias or name}"


def stripped(x):
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


ORACLES = {}

# -- urls ------------------------------------------------------------------------------------------

FORMS = f"""
forms AS (SELECT page_id, CAST(form AS INTEGER) AS form, {I.URL_FORMS} AS url FROM pages, range(0, 11) r(form))
"""

_PLAIN = [r for r in K.DEFAULT_SUFFIXES if not r.startswith(("!", "*."))]
_WILD = [r[2:] for r in K.DEFAULT_SUFFIXES if r.startswith("*.")]
_EXCEPT = [r[1:] for r in K.DEFAULT_SUFFIXES if r.startswith("!")]

SPLIT = rf"""
{FORMS},
matched AS (
  SELECT *, regexp_extract(
    regexp_replace(replace(replace(replace(url, chr(9), ''), chr(10), ''), chr(13), ''), '^[\x00-\x20]+', ''),
    '(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)', ['s', 'n', 'p']) AS x
  FROM forms),
parts AS (
  SELECT page_id, form, url, lower(x.s) AS scheme, x.n AS netloc,
         CASE WHEN list_contains({listed(K.PARAM_SCHEMES)}, lower(x.s)) THEN regexp_replace(x.p, ';[^/]*$', '')
              ELSE x.p END AS path
  FROM matched)
"""

HOSTS = rf"""
{SPLIT},
authority AS (
  SELECT *, {stripped(r"regexp_extract(regexp_extract(regexp_replace(url, '^(?:[A-Za-z0-9+.\-]+:)?//', ''), '^[^/?#]*'), '[^@]*$')")} AS a
  FROM parts),
host AS (
  SELECT *, CASE WHEN regexp_matches(a, '^\[[^\]]*\]') THEN regexp_extract(a, '^\[[^\]]*\]')
                 ELSE rtrim({stripped("split_part(a, ':', 1)")}, '.') END AS h
  FROM authority),
labelled AS (
  SELECT *, string_split(h, '.') AS ls, string_split(lower(h), '.') AS low,
         regexp_matches(h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$|^\[.*:.*\]$') AS ip
  FROM host),
suffixed AS (
  SELECT *, CASE WHEN ip THEN 0 ELSE coalesce(list_max(list_transform(range(1, least(len(low), 3) + 1), lambda k:
    CASE WHEN list_contains({listed(_EXCEPT)}, array_to_string(low[len(low) - k + 1:], '.')) THEN k - 1
         WHEN list_contains({listed(_PLAIN)}, array_to_string(low[len(low) - k + 1:], '.')) THEN k
         WHEN k > 1 AND list_contains({listed(_WILD)}, array_to_string(low[len(low) - k + 2:], '.')) THEN k
         ELSE 0 END)), 0) END AS k
  FROM labelled),
hosts AS (
  SELECT *,
    CASE WHEN ip OR len(ls) - k < 1 THEN '' ELSE array_to_string(ls[1:len(ls) - k - 1], '.') END AS subdomain,
    CASE WHEN ip THEN h WHEN len(ls) - k < 1 THEN '' ELSE ls[len(ls) - k] END AS domain,
    CASE WHEN ip OR k = 0 THEN '' ELSE array_to_string(ls[len(ls) - k + 1:], '.') END AS suffix
  FROM suffixed)
"""


def entropy(x):
    chars = f"string_split({x}, '')"
    share = f"(len(list_filter({chars}, lambda y: y = c)) / len({chars})::DOUBLE)"
    return (
        f"CASE WHEN length({x}) = 0 THEN 0.0::DOUBLE ELSE round(abs("
        f"list_sum(list_transform(list_distinct({chars}), lambda c: -{share} * log2({share})))), 6) END"
    )


def count_char(char):
    return f"CAST(length(u) - length(replace(u, '{char}', '')) AS INTEGER)"


_IP = r"regexp_matches(n, '^\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}')"
_FEATURES = {
    "url_length": "length(u)",
    "domain_length": "length(d)",
    "path_length": "length(path)",
    **{name: count_char(char) for name, char in K.COUNTED_CHARS.items()},
    "num_digits": f"len(regexp_extract_all(u, '[{DIGIT}]'))",
    "url_entropy": entropy("u"),
    "domain_entropy": entropy("d"),
    "has_ip_address": _IP,
    "suspicious_token_count": " + ".join(f"CAST(contains(lower(u), '{w}') AS INTEGER)" for w in K.SUSPICIOUS_TOKENS),
    "has_risky_tld": " OR ".join(f"suffix(lower(u), '{t}')" for t in K.RISKY_TLDS),
    "is_https": "scheme = 'https'",
    "has_port": f"contains(n, ':') AND NOT {_IP}",
    "subdomain_count": "CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END",
    "domain_has_digits": f"regexp_matches(d, '[{DIGIT}]')",
}

_BAD = f"""(u = '' OR contains(n, '[') <> contains(n, ']')
  OR (contains(n, '[') AND NOT regexp_matches(n, '\\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\\]'))
  OR regexp_matches(n, '[{K.DELIMITER_LOOKALIKES}]'))"""


def features(*names, source="forms", ids=("page_id", "form")):
    def column(name):
        if name in K.ENTROPY_FEATURES:
            return f"CASE WHEN {_BAD} THEN 0.0::DOUBLE ELSE {_FEATURES[name]} END AS {name}"
        return f"CASE WHEN {_BAD} THEN 0 ELSE CAST({_FEATURES[name]} AS INTEGER) END AS {name}"

    hosts = HOSTS if source == "forms" else HOSTS.replace(FORMS, source)
    # Null urls take part as empty ones.
    hosts = hosts.replace("  FROM forms)", "  FROM (SELECT * REPLACE (coalesce(url, '') AS url) FROM forms))")
    return f"""WITH {hosts},
    named AS (SELECT *, url AS u, netloc AS n, domain AS d FROM hosts)
    SELECT {', '.join(ids)}, {', '.join(column(n) for n in names)} FROM named"""


ORACLES["url_split"] = f"WITH {SPLIT} SELECT page_id, form, scheme, netloc, path FROM parts"
ORACLES["url_domain_parts"] = f"""
WITH {HOSTS} SELECT page_id, form, subdomain, domain, CASE WHEN url IS NOT NULL THEN suffix END AS suffix FROM hosts"""
ORACLES["url_domain_parts_joined"] = ORACLES["url_domain_parts"]
ORACLES["url_features"] = features(*K.URL_FEATURES)
ORACLES["url_char_counts"] = features(*K.COUNTED_CHARS, "num_digits")
ORACLES["url_entropy"] = features(*K.ENTROPY_FEATURES)
ORACLES["url_host_flags"] = features("has_ip_address", "is_https", "has_port")
ORACLES["url_tokens"] = features("suspicious_token_count", "has_risky_tld")

_TOP = sorted([(n, float(i * 7 % 18)) for i, n in enumerate(K.URL_FEATURES)], key=lambda p: -p[1])[:5]
ORACLES["top_features"] = f"WITH f AS ({features(*[n for n, _ in _TOP])}) " + " UNION ALL ".join(
    f"SELECT page_id, form, {i}::INTEGER AS rank, '{n}' AS feature, CAST({n} AS DOUBLE) AS value, "
    f"{w}::DOUBLE AS importance FROM f"
    for i, (n, w) in enumerate(_TOP)
)

# -- sources ---------------------------------------------------------------------------------------

_SPAM = "(contains(url, 'spam-farm') OR contains(url, 'cheap-pills'))"
ORACLES["load_url_training"] = f"""
WITH x AS ({features("url_length", "domain_length", "path_length", "num_digits", "url_entropy",
             source="forms AS (SELECT page_id, 0 AS form, url FROM pages)", ids=("page_id", "url"))})
SELECT page_id, url, CAST({_SPAM} AS INTEGER) AS label, url_length, domain_length, path_length, num_digits, url_entropy
FROM x"""

LABELLED = "labelled_docs AS (SELECT doc_id, text, toxic AS label FROM documents JOIN labels USING (doc_id))"
ORACLES["load_text_training"] = f"""
WITH {LABELLED} SELECT doc_id, text, label FROM labelled_docs
WHERE doc_id % 11 > 2 AND text NOT IN ({', '.join(quoted(c) for c in K.MISSING_CELLS)}) AND {stripped('text')} <> ''"""
ORACLES["load_text_lenient"] = ORACLES["load_text_training"]
ORACLES["model_metadata"] = f"""
WITH {LABELLED}, c AS (SELECT DISTINCT label, CASE WHEN label = 1 THEN 'PHISHING' ELSE 'BENIGN' END AS name
                       FROM labelled_docs)
SELECT 'gbt_tfidf' AS model_type, CAST(count(*) AS INTEGER) AS num_labels,
       string_agg(label || '=' || name, ',' ORDER BY label) AS id2label,
       CAST(max(label) FILTER (WHERE name = 'PHISHING') AS INTEGER) AS phishing_id,
       CAST({K.MAX_FEATURES} AS INTEGER) AS max_features, 'TF-IDF with boosted trees' AS note
FROM c"""

# -- filters, samples, splits ----------------------------------------------------------------------

ORACLES["clean_text"] = f"""
SELECT * FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' ' || chr(9) || chr(10) WHEN 1 THEN NULL
                                   ELSE ' ' || text END AS text FROM documents)
WHERE text IS NOT NULL AND {stripped('text')} <> ''"""

RANKED = f"""
{LABELLED},
ranked AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{K.SEED}:' || doc_id), doc_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total
  FROM labelled_docs)
"""
ORACLES["balanced_sample"] = f"WITH {RANKED} SELECT doc_id, label FROM ranked WHERE total <= 120 OR rn <= 60"
SPLIT_ROWS = f"""
{RANKED},
shares AS (
  SELECT label, n, total - ceil(total * 0.2::DOUBLE) AS n_train, (total - ceil(total * 0.2::DOUBLE)) * n / total AS exact
  FROM (SELECT DISTINCT label, n, total FROM ranked)),
placed AS (
  SELECT label, n - floor(exact) - CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
           <= n_train - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_test
  FROM shares),
split AS (SELECT doc_id, label, rn <= n_test AS is_test FROM ranked JOIN placed USING (label))
"""
ORACLES["stratified_split"] = f"WITH {SPLIT_ROWS} SELECT doc_id, label, is_test FROM split"
ORACLES["split_sizes"] = f"WITH {SPLIT_ROWS} SELECT is_test, count(*) AS n_rows FROM split GROUP BY is_test"
ORACLES["kfold_assign"] = f"""
WITH {LABELLED},
firsts AS (SELECT label, min(doc_id) AS first_id FROM labelled_docs GROUP BY label),
lined AS (SELECT doc_id, label, row_number() OVER (ORDER BY first_id, doc_id) - 1 AS pos,
                 row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn
          FROM labelled_docs JOIN firsts USING (label)),
sizes AS (SELECT label, pos % 5 AS fold, count(*) AS n FROM lined GROUP BY ALL),
ends AS (SELECT label, fold, sum(n) OVER (PARTITION BY label ORDER BY fold) AS stop FROM sizes)
SELECT doc_id, l.label, CAST(min(fold) AS INTEGER) AS fold FROM lined l JOIN ends e ON l.label = e.label AND l.rn <= e.stop
GROUP BY doc_id, l.label"""
ORACLES["class_distribution"] = f"WITH {LABELLED} SELECT label, count(*) AS n FROM labelled_docs GROUP BY label"

# -- text ------------------------------------------------------------------------------------------

WORDS = r"""
words AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS w FROM documents)
"""
KEPT = f"""
{WORDS}, kept AS (SELECT doc_id, list_filter(w, lambda x: NOT list_contains({listed(K.ENGLISH_STOP_WORDS)}, x)) AS w FROM words)
"""
TERMS = f"""
{KEPT}, terms AS (
  SELECT doc_id, list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS t
  FROM kept)
"""
VOCABULARY = """
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM {source}) GROUP BY ALL),
n AS (SELECT count(*) AS n_docs FROM {source}),
frequencies AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM counts GROUP BY term),
bounded AS (SELECT frequencies.* FROM frequencies, n WHERE df >= 2 AND df <= 0.8::DOUBLE * n_docs),
vocabulary AS (
  SELECT term, df, tf, ln((1.0::DOUBLE + n_docs) / (1.0::DOUBLE + df)) + 1 AS idf
  FROM (SELECT * FROM bounded ORDER BY tf DESC, term LIMIT {k}), n)
"""
_ALL_TERMS = f"WITH {TERMS}, {VOCABULARY.format(source='terms', k=K.MAX_FEATURES)}"
_WEIGHTED = "weighted AS (SELECT doc_id, term, c.tf, c.tf * idf AS w FROM {counts} c JOIN vocabulary USING (term))"

ORACLES["tokens"] = f"""
WITH {WORDS} SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens FROM words"""
ORACLES["stopword_tokens"] = f"""
WITH {KEPT} SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens FROM kept"""
ORACLES["ngrams"] = f"""
WITH {TERMS} SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(t, '|') AS terms FROM terms"""
ORACLES["vocab_df"] = f"{_ALL_TERMS} SELECT term, df, tf FROM bounded"
ORACLES["vocab_topk"] = f"{_ALL_TERMS} SELECT term, df, tf, {r6('idf')} FROM vocabulary"
ORACLES["tfidf"] = f"""
{_ALL_TERMS}, {_WEIGHTED.format(counts='counts')}
SELECT doc_id, term, CAST(tf AS INTEGER) AS tf, {r6('w', 'tfidf')} FROM weighted"""
ORACLES["tfidf_l2"] = f"""
{_ALL_TERMS}, {_WEIGHTED.format(counts='counts')}
SELECT doc_id, term, CAST(tf AS INTEGER) AS tf, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'tfidf')}
FROM weighted"""
ORACLES["tfidf_joined"] = ORACLES["tfidf_l2"]
ORACLES["tfidf_transform"] = f"""
WITH {TERMS}, even AS (SELECT * FROM terms WHERE doc_id % 2 = 0),
{VOCABULARY.format(source='even', k=K.MAX_FEATURES)},
odd AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM terms WHERE doc_id % 2 = 1)
        GROUP BY ALL),
{_WEIGHTED.format(counts='odd')}
SELECT doc_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))', 'tfidf')} FROM weighted"""

# -- scoring decisions -----------------------------------------------------------------------------

_T = f"{K.CONFIDENCE_THRESHOLD}::DOUBLE"


def label(s):
    return f"CASE WHEN {s} >= 0.5 THEN 'phishing' ELSE 'benign' END"


def confidence(s):
    return f"CASE WHEN {s} >= {_T} OR {s} <= 1.0::DOUBLE - {_T} THEN 'high' ELSE 'low' END"


ORACLES["tier_decision"] = f"""
WITH s AS (SELECT doc_id, text, coalesce({I.SCORE1}, 0.15::DOUBLE) AS score FROM (SELECT *, doc_id AS id FROM documents))
SELECT doc_id, score, {label('score')} AS label, {confidence('score')} AS confidence,
       {confidence('score')} = 'low' AS escalate, 2::INTEGER AS tier, '{K.TEXT_MODEL_NAME}' AS model,
       {_T} AS threshold, CAST(length(text) AS INTEGER) AS text_length
FROM s"""
ORACLES["score_contract"] = """
SELECT doc_id, 0::INTEGER AS n_violations, CAST(length(text) AS INTEGER) AS text_length FROM documents"""
ORACLES["model_roundtrip"] = f"""
WITH {I.MESSAGES_SQL} SELECT 0::BIGINT AS n_drifted, count(*) AS n_scored FROM messages"""
ORACLES["result_violations"] = f"""
WITH {I.order_scores_sql(I.BAD_SCORE1, I.BAD_SCORE2)}
SELECT id, array_to_string(list_filter([
  CASE WHEN tier1_score IS NULL THEN 'missing score' END,
  CASE WHEN tier1_score > 1 THEN 'score out of range' END,
  CASE WHEN id % 5 = 0 THEN 'unknown label' END,
  CASE WHEN id % 19 = 0 THEN 'unknown confidence' END,
  CASE WHEN tier1_score IS NULL THEN NULL END,
  CASE WHEN id % 23 = 0 THEN 'wrong tier' END], lambda v: v IS NOT NULL), ';') AS violations
FROM tiers"""
ORACLES["score_drift"] = f"""
WITH {I.order_scores_sql()} SELECT id, {r6('coalesce(tier1_score, 0.5)', 'score_a')} FROM tiers WHERE id % 6 = 0"""
ORACLES["softmax_binary"] = f"""
WITH {I.LINE_SCORES_SQL}, l AS (SELECT id, {I.LOGIT0} AS a, {I.LOGIT1} AS b FROM lines)
SELECT id, {r6('1 / (1 + exp(a - b))', 'score')}, CASE WHEN b > a THEN 1 ELSE 0 END AS prediction FROM l"""

# -- evaluation ------------------------------------------------------------------------------------

CELLS = f"""
{I.LINE_SCORES_SQL},
cells AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
                 count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                 count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                 count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM predicted)
"""
ORACLES["confusion_matrix"] = f"WITH {CELLS} SELECT * FROM cells"
ORACLES["binary_metrics"] = f"""
WITH {CELLS}, m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p,
                           coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM cells)
SELECT {r6('(tp + tn) / (tp + tn + fp + fn)::DOUBLE', 'accuracy')}, {r6('p', 'precision')}, {r6('r', 'recall')},
       {r6('coalesce(2 * p * r / nullif(p + r, 0), 0)', 'f1')} FROM m"""
ORACLES["classification_report"] = f"""
WITH {I.LINE_SCORES_SQL},
per AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS said,
               count(*) FILTER (WHERE label = c AND prediction = c) AS hit FROM predicted, range(0, 2) k(c) GROUP BY c),
pr AS (SELECT c, support, coalesce(hit / nullif(said, 0)::DOUBLE, 0) AS p,
              coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS r, hit FROM per),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr),
rows AS (
  SELECT CASE c WHEN 0 THEN 'Benign' ELSE 'Phishing' END AS row, p, r, f1, support FROM f
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support)::DOUBLE, sum(hit) / sum(support)::DOUBLE,
                   sum(hit) / sum(support)::DOUBLE, sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT row, {r6('p', 'precision')}, {r6('r', 'recall')}, {r6('f1')}, CAST(support AS BIGINT) AS support FROM rows"""


def auc_sql(rows, by=""):
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    columns = f"{by}, " if by else ""
    return f"""
ranked AS (SELECT *, rank() OVER ({part} ORDER BY score) AS lo, count(*) OVER ({part}
             ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM {rows})
SELECT {columns}round((sum((lo + hi) / 2.0::DOUBLE) FILTER (WHERE label = 1)
   - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
   / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))::DOUBLE, 6) AS auc
FROM ranked {group}"""


ORACLES["roc_auc"] = f"WITH {I.LINE_SCORES_SQL}, {auc_sql('scored')}"
ORACLES["roc_auc_by_part"] = f"""
WITH {I.LINE_SCORES_SQL}, parted AS (SELECT id % 3 AS part, label, score + id / 1e9::DOUBLE AS score FROM scored),
{auc_sql('parted', 'part')}"""
CASES = f"""
{I.LINE_SCORES_SQL}, cases AS (
  SELECT id, score, {label('score')} AS label, CASE WHEN label = 1 THEN 'phishing' ELSE 'benign' END AS expected FROM scored)
"""
ORACLES["accuracy_gate"] = f"""
WITH {CASES} SELECT count(*) FILTER (WHERE label = expected) AS correct, count(*) AS total,
                    count(*) FILTER (WHERE label = expected) >= 4 AS passed FROM cases"""
ORACLES["misclassified"] = f"""
WITH {CASES} SELECT id, printf('Expected ''%s'', got ''%s'' (score=%.4f)', expected, label, score) AS note
FROM cases WHERE label <> expected"""

# -- fusion ----------------------------------------------------------------------------------------


def fused(weights, zone, source="tiers"):
    (w1, w2), (low, high) = weights, zone
    return f"""
fused AS (
  SELECT *,
    CASE WHEN tier1_score IS NOT NULL AND tier2_score IS NOT NULL
         THEN ({w1}::DOUBLE * tier1_score + {w2}::DOUBLE * tier2_score) / ({w1}::DOUBLE + {w2}::DOUBLE)
         ELSE coalesce(tier1_score, tier2_score) END AS score,
    CASE WHEN tier1_score IS NULL THEN 'tier2_only' WHEN tier2_score IS NULL THEN 'tier1_only'
         ELSE 'weighted_average' END AS fusion_method,
    (tier1_score IS NULL OR (tier1_score >= {low}::DOUBLE AND tier1_score <= {high}::DOUBLE)) AND
    (tier2_score IS NULL OR (tier2_score >= {low}::DOUBLE AND tier2_score <= {high}::DOUBLE)) AS escalate,
    CASE WHEN score < 0.4 THEN 'Low' WHEN score < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level
  FROM {source} WHERE tier1_score IS NOT NULL OR tier2_score IS NOT NULL)
"""


def fusion_sql(weights, zone):
    return f"""
WITH {I.order_scores_sql()}, {fused(weights, zone)}
SELECT id, score, {label('score')} AS label, risk_level, CASE WHEN escalate THEN 'low' ELSE 'high' END AS confidence,
       escalate, tier1_score, tier2_score, {weights[0]}::DOUBLE AS weight1, {weights[1]}::DOUBLE AS weight2, fusion_method
FROM fused"""


def reason(source, s):
    return f"""CASE WHEN {s} IS NULL THEN '' ELSE '{source} analysis shows ' ||
      CASE WHEN {s} > 0.7 THEN 'high' WHEN {s} > 0.4 THEN 'moderate' ELSE 'low' END ||
      printf(' phishing risk (score: %.2f)|', {s}) END"""


REASONS = f"{reason('URL', 'tier1_score')} || {reason('Text', 'tier2_score')} || 'Combined risk level: ' || risk_level"

ORACLES["fuse_scores"] = fusion_sql((1.0, 1.0), (0.3, 0.7))
ORACLES["fuse_scores_weighted"] = fusion_sql((0.7, 0.2), (0.25, 0.75))
ORACLES["fusion_rejects"] = f"""
WITH {I.order_scores_sql(I.BAD_SCORE1, I.BAD_SCORE2)}
SELECT * FROM (SELECT id,
  CASE WHEN tier1_score IS NULL AND tier2_score IS NULL THEN 'no tier has a score'
       WHEN tier1_score > 1 THEN 'Tier 1 score lies outside 0 to 1: 1.25'
       WHEN isnan(tier2_score) THEN 'Tier 2 score lies outside 0 to 1: NaN' END AS reject_reason FROM tiers)
WHERE reject_reason IS NOT NULL"""
ORACLES["risk_levels"] = f"""
WITH {I.order_scores_sql()}, {fused((1.0, 1.0), (0.3, 0.7))}
SELECT risk_level, count(*) AS n FROM fused GROUP BY risk_level"""
ORACLES["fusion_reasoning"] = f"""
WITH {I.order_scores_sql()}, {fused((1.0, 1.0), (0.3, 0.7))} SELECT id, {REASONS} AS reasoning FROM fused"""

# -- routing ---------------------------------------------------------------------------------------

ORACLES["route_inputs"] = f"""
WITH {I.MESSAGES_SQL}
SELECT msg_id, coalesce(url, '') <> '' AS run_tier1, coalesce(text, '') <> '' AS run_tier2,
       CASE WHEN coalesce(url, '') = '' AND coalesce(text, '') = ''
            THEN 'the message has neither a url nor a text' END AS reject_reason
FROM messages"""

KEY = (
    f"md5({stripped('lower(coalesce(url, {e}))')} || '||' || {stripped('coalesce(text, {e})')})".replace("{e}", "''")
)
ROUTED = f"""
{I.MESSAGES_SQL},
usable AS (SELECT *, msg_id AS id FROM messages WHERE coalesce(url, '') <> '' OR coalesce(text, '') <> ''),
tiers AS (SELECT *, CASE WHEN coalesce(url, '') <> '' THEN coalesce({I.SCORE1}, 0.5::DOUBLE) END AS tier1_score,
                    CASE WHEN coalesce(text, '') <> '' THEN coalesce({I.SCORE2}, 0.5::DOUBLE) END AS tier2_score FROM usable),
{fused((1.0, 1.0), (0.3, 0.7))},
queue AS (SELECT *, {KEY} AS cache_key FROM fused WHERE force_expert OR escalate),
direct AS (SELECT * FROM fused WHERE NOT (force_expert OR escalate)),
asked AS (SELECT cache_key, arg_min(url, msg_id) AS url, arg_min(text, msg_id) AS text, min(msg_id) AS asked_id
          FROM queue GROUP BY cache_key),
{I.EXPERT_SQL.replace("FROM queue", "FROM asked")},
answered AS (SELECT queue.*, verdict, points, status, n, m, asked_id FROM queue JOIN expert USING (cache_key)),
verdicts AS (
  SELECT msg_id, {label('score')} AS result, risk_level, CASE WHEN escalate THEN 'low' ELSE 'high' END AS confidence,
         {REASONS} AS reasoning, 'fusion' AS tier_used, force_expert FROM direct
  UNION ALL
  SELECT msg_id, verdict, CASE WHEN verdict = 'phishing' THEN 'High' ELSE 'Low' END, 'high', points, '3', force_expert
  FROM answered)
"""
ORACLES["escalation_queue"] = f"WITH {ROUTED} SELECT msg_id, force_expert, escalate FROM queue"
ORACLES["final_verdicts"] = f"""
WITH {ROUTED} SELECT msg_id, result, risk_level, confidence, reasoning, tier_used FROM verdicts"""
ORACLES["verdict_details"] = f"""
WITH {ROUTED}
SELECT msg_id, tier1_score, CASE WHEN tier1_score IS NOT NULL THEN {confidence('tier1_score')} END AS tier1_confidence,
       tier2_score, CASE WHEN tier2_score IS NOT NULL THEN CAST(length(text) AS INTEGER) END AS text_length,
       fusion_method, tier3_result, tier3_confidence, tokens
FROM (SELECT * EXCLUDE (verdict, points, status, n, m, asked_id, cache_key), verdict AS tier3_result,
             CASE WHEN status = 'ok' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS tier3_confidence,
             CASE WHEN status = 'ok' THEN CAST(n + m AS INTEGER) ELSE 0 END AS tokens FROM answered
      UNION ALL SELECT *, NULL, NULL, NULL FROM direct)"""
ORACLES["cached_verdicts"] = f"""
WITH {ROUTED}
SELECT msg_id, verdict AS result, status = 'ok' AS cache_hit,
       CASE WHEN status = 'ok' THEN CAST(n + m AS INTEGER) ELSE 0 END AS tokens,
       CASE status WHEN 'rate_limited' THEN 'slow down' WHEN 'api_error' THEN 'broken' END AS error
FROM answered"""
ORACLES["routing_stats"] = f"""
WITH {ROUTED}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE tier_used = '3') AS expert_rows,
       count(*) FILTER (WHERE tier_used = '3' AND NOT force_expert) AS escalated,
       count(*) FILTER (WHERE tier_used = '3' AND force_expert) AS forced
FROM verdicts"""

# -- expert and cache ------------------------------------------------------------------------------

ORACLES["expert_prompt"] = f"""
WITH {I.MESSAGES_SQL}
SELECT msg_id, {quoted(K.PROMPT_HEAD)} || coalesce(url, '') || {quoted(K.PROMPT_MIDDLE)}
  || left(coalesce(text, ''), {K.PROMPT_TEXT_CHARS}) || {quoted(K.PROMPT_TAIL)} AS prompt FROM messages"""
ORACLES["expert_batch"] = f"""
WITH {I.MESSAGES_SQL},
queue AS (SELECT k AS cache_key, arg_min(url, msg_id) AS url, arg_min(text, msg_id) AS text
          FROM (SELECT *, {KEY} AS k FROM messages WHERE coalesce(url, '') <> '' OR coalesce(text, '') <> '') GROUP BY k),
{I.EXPERT_SQL}
SELECT cache_key, verdict AS result, CASE WHEN status = 'ok' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
       points AS reasoning, CASE WHEN status = 'ok' THEN CAST(n + m AS INTEGER) ELSE 0 END AS tokens,
       CASE status WHEN 'rate_limited' THEN 'slow down' WHEN 'api_error' THEN 'broken' END AS error
FROM expert"""

RESPONSES = f"""
responses AS (
  SELECT doc_id, {I.RESPONSE} AS response, CAST(n_chars AS INTEGER) AS input_tokens,
         CAST(doc_id % 100 AS INTEGER) AS output_tokens, {I.STATUS} AS status, CAST(doc_id % 7 AS BIGINT) AS response_time_ms
  FROM documents),
parsed AS (
  SELECT *, coalesce(nullif(lower(regexp_extract(response, '(?i)VERDICT:[{SPACE}]*(phishing|safe)', 1)), ''), 'phishing') AS verdict,
         list_transform(regexp_extract_all(regexp_extract(response, '(?is)REASONING:[{SPACE}]*(.*)', 1),
                        '-[{SPACE}]*(.+)', 1)[1:3], lambda b: {stripped('b')}) AS bullets
  FROM responses),
pointed AS (SELECT *, CASE WHEN len(bullets) > 0 THEN array_to_string(bullets, '|') ELSE '{K.NO_REASON}' END AS points FROM parsed)
"""
ORACLES["parse_verdict"] = f"WITH {RESPONSES} SELECT doc_id, verdict FROM pointed"
ORACLES["parse_reasoning"] = f"WITH {RESPONSES} SELECT doc_id, points AS reasoning FROM pointed"
_RESULT_TAIL = "3::INTEGER AS tier, 'stub' AS model, {tokens} AS tokens, false AS cache_hit, response_time_ms, {error} AS error"
ORACLES["expert_result"] = f"""
WITH {RESPONSES} SELECT doc_id, verdict AS result, 1.0::DOUBLE AS confidence, points AS reasoning,
{_RESULT_TAIL.format(tokens='input_tokens + output_tokens', error='NULL::VARCHAR')} FROM pointed WHERE status = 'ok'"""
ORACLES["expert_fallback"] = f"""
WITH {RESPONSES} SELECT doc_id, 'phishing' AS result, 0.5::DOUBLE AS confidence,
CASE status WHEN 'rate_limited' THEN '{K.RATE_LIMITED_REASON}' ELSE '{K.API_ERROR_REASON}' END AS reasoning,
{_RESULT_TAIL.format(tokens='0::INTEGER', error="'code ' || doc_id")} FROM pointed WHERE status <> 'ok'"""
ORACLES["cache_key"] = f"""
WITH {I.MESSAGES_SQL}
SELECT msg_id, md5(lower({stripped("coalesce(url, '')")}) || '||' || {stripped("coalesce(text, '')")}) AS cache_key FROM messages"""

CACHE = f"""
{I.MESSAGES_SQL},
keyed AS (SELECT *, {KEY} AS cache_key FROM messages),
stored AS (SELECT cache_key, unnest([(msg_id * 5) % 48, (msg_id * 11) % 48]) AS age FROM keyed WHERE msg_id % 3 <> 0),
newest AS (SELECT cache_key, min(age) AS age FROM stored GROUP BY cache_key),
fresh AS (SELECT * FROM newest WHERE age * 3600 <= 86400)
"""
_VERDICT = "CASE WHEN age % 2 = 0 THEN 'safe' ELSE 'phishing' END"
_CREATED = f"{I.NOW}::DOUBLE - CAST(age AS DOUBLE) * 3600"
ORACLES["cache_lookup"] = f"""
WITH {CACHE}
SELECT msg_id, CASE WHEN age IS NOT NULL THEN {_VERDICT} END AS result, 'age ' || age AS reason,
       CAST(age AS INTEGER) AS tokens, CASE WHEN age IS NOT NULL THEN true END AS cache_hit,
       CASE WHEN age IS NOT NULL THEN 3::BIGINT END AS response_time_ms
FROM keyed LEFT JOIN fresh USING (cache_key)"""
ORACLES["cache_store_lookup"] = f"""
WITH {CACHE}
SELECT msg_id, CASE WHEN age IS NOT NULL THEN {_VERDICT} END AS result, CAST(age AS INTEGER) AS tokens,
       CASE WHEN age IS NOT NULL THEN true END AS cache_hit
FROM keyed LEFT JOIN fresh USING (cache_key)"""
ORACLES["cache_misses"] = f"""
WITH {CACHE}
SELECT cache_key, count(*) AS n_messages FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM fresh) GROUP BY cache_key"""
ORACLES["cache_upsert"] = f"WITH {CACHE} SELECT cache_key, {_CREATED} AS created_at, {_VERDICT} AS result FROM newest"
_STATS = f"count(*) AS entry_count, {I.NOW}::DOUBLE - max(age) * 3600 AS oldest_entry, {I.NOW}::DOUBLE - min(age) * 3600 AS newest_entry"
ORACLES["cache_stats"] = f"WITH {CACHE} SELECT {_STATS} FROM newest"
ORACLES["cache_store"] = f"WITH {CACHE} SELECT {_STATS} FROM fresh"
ORACLES["cache_cleared"] = f"""WITH {CACHE} SELECT count(*) AS "before", 0::BIGINT AS "after" FROM newest"""

# -- opened mail -----------------------------------------------------------------------------------

OPENED = f"""
{I.MAIL_SQL}, opened AS (SELECT *, regexp_extract(hash, '#inbox/([^/]+)', 1) AS mail_id FROM mail
                         WHERE regexp_matches(hash, '#inbox/[^/]+'))
"""
ORACLES["mail_id"] = f"WITH {OPENED} SELECT event_id, mail_id FROM opened"
ORACLES["mail_opens"] = f"""
WITH {OPENED}, l AS (SELECT *, lag(mail_id) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM opened)
SELECT event_id, session_id, mail_id FROM l WHERE mail_id IS DISTINCT FROM before"""
ORACLES["mail_opens_stream"] = ORACLES["mail_opens"]
ORACLES["mail_payload"] = f"WITH {I.MAIL_SQL} SELECT event_id, 'OPENED_EMAIL' AS type, email, name, content FROM mail"
ORACLES["mail_dashboard"] = f"""
WITH {I.MAIL_SQL} SELECT event_id, coalesce(email, '(unknown)') AS email, coalesce(name, '(unknown)') AS name,
coalesce(content, '') AS content FROM mail WHERE type = 'OPENED_EMAIL'"""
ORACLES["stream_capture"] = f"""
WITH {I.MAIL_SQL} SELECT event_id, type, email, name, content, session_id FROM mail WHERE type = 'OPENED_EMAIL'"""
ORACLES["stream_score"] = f"""
WITH {I.MAIL_SQL} SELECT event_id AS msg_id, nullif(regexp_extract(content, 'https?://[^\\s<>"'']+'), '') AS url,
content IS NOT NULL AS has_tier1, content IS NOT NULL AS has_result,
CASE WHEN content IS NULL THEN 'the message has neither a url nor a text' END AS reject_reason
FROM mail WHERE type = 'OPENED_EMAIL'"""
ORACLES["message_outcomes"] = f"""
WITH {ROUTED.replace(I.MESSAGES_SQL, I.MESSAGES_SQL + ", given AS (SELECT * FROM messages)")}
SELECT msg_id, result, CAST(NULL AS VARCHAR) AS reject_reason FROM verdicts
UNION ALL SELECT msg_id, NULL, 'the message has neither a url nor a text' FROM given
WHERE coalesce(url, '') = '' AND coalesce(text, '') = ''"""
ORACLES["skip_cache"] = f"""
WITH {ROUTED} SELECT msg_id, verdict AS result, false AS cache_hit FROM answered"""

# -- models: what SQL can state of them ------------------------------------------------------------

_SUPPORTS = """
SELECT "row", support, true AS in_range FROM (
  SELECT 'Benign' AS "row", count(*) FILTER (WHERE label = 0) AS support FROM tested
  UNION ALL SELECT 'Phishing', count(*) FILTER (WHERE label = 1) FROM tested
  UNION ALL SELECT x, count(*) FROM tested, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(x) GROUP BY x)"""
ORACLES["train_text_model"] = f"""
WITH {SPLIT_ROWS}, tested AS (SELECT label FROM split WHERE is_test) {_SUPPORTS}"""
_URL_ROWS = f"labelled_docs AS (SELECT page_id AS doc_id, url AS text, CAST({_SPAM} AS INTEGER) AS label FROM pages)"
_URL_SPLIT = SPLIT_ROWS.replace(LABELLED, _URL_ROWS)
ORACLES["train_url_model"] = f"""
WITH {_URL_SPLIT}, tested AS (SELECT label FROM split WHERE is_test) {_SUPPORTS}"""
ORACLES["score_url"] = f"WITH {FORMS} SELECT page_id, form, true AS consistent FROM forms"
ORACLES["score_text"] = """
SELECT doc_id, true AS consistent, CAST(length(coalesce(text, '')) AS INTEGER) AS text_length FROM documents"""
ORACLES["early_stopping"] = "SELECT true AS ended_rightly, true AS best_trees_kept, true AS in_range"
ORACLES["feature_importance"] = "SELECT 10::BIGINT AS n_features, true AS sorted, true AS shares"
ORACLES["cv_auc"] = "SELECT 5::BIGINT AS n_folds, true AS in_range, true AS as_by_library"
ORACLES["analyze"] = f"""
WITH {I.MESSAGES_SQL} SELECT msg_id, true AS has_result, true AS consistent FROM messages
WHERE coalesce(url, '') <> '' OR coalesce(text, '') <> ''"""
