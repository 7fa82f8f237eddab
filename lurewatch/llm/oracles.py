"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op9_exact_dedup": """
        WITH keyed AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        groups AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
        FROM keyed JOIN groups USING (body)
    """,
    "op5_benchmark_decontamination": f"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS words FROM documents),
        items AS (SELECT item_id, {_ALNUM_WORDS} AS words FROM benchmark),
        item_windows AS (
            SELECT DISTINCT item_id, list_slice(words, i, i + 9) AS gram
            FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM items WHERE len(words) > 0)
        ),
        sizes AS (SELECT DISTINCT len(gram) AS n FROM item_windows),
        grams AS (
            SELECT r, n, i, list_slice(words, i, i + n - 1) AS gram FROM (
                SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n)
        ),
        hits AS (SELECT r, i, n, item_id FROM grams JOIN item_windows USING (gram)),
        words_hit AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS w FROM hits) GROUP BY r),
        items_hit AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words_hit USING (r) LEFT JOIN items_hit USING (r)
    """,
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id
            HAVING 100 * count(*) >= 80 * ((SELECT n FROM sizes WHERE doc_id = a.doc_id)
                + (SELECT n FROM sizes WHERE doc_id = b.doc_id) - count(*))
        ),
        edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach(d, root) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.d
        ),
        roots AS (SELECT d, min(root) AS component_id FROM reach GROUP BY d)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) JOIN roots ON roots.d = doc_id
    """,
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
        ),
        each AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
        kept AS (SELECT lang, term FROM each GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        counted AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
        pairs_of AS (SELECT DISTINCT lang, source FROM docs),
        sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        dense AS (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n
            FROM pairs_of g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        own AS (
            SELECT lang, source, term, n,
                1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
            FROM dense JOIN sizes USING (lang)
        ),
        whole AS (
            SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
            FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL) JOIN sizes USING (lang)
        ),
        apart AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM pairs_of a JOIN pairs_of b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op11_itq_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.95
        ),
        reach(vec_id, root) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT l.v, r.root FROM reach r JOIN links l ON l.u = r.vec_id
        ),
        roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
        counts AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM roots LEFT JOIN counts USING (vec_id)
    """,
    "op13_hard_negatives": """
        WITH given AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM given a JOIN given b ON a.id <> b.id WHERE a.id % 100 = 0
        ),
        positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
            id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        QUALIFY rank <= 5
    """,
}
