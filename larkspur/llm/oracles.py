"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

WORDS = r"""SELECT doc_id, i, word FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents))"""

OP4 = f"""WITH words AS ({WORDS.format(text="coalesce(text, '')")}),
win AS (SELECT * FROM (SELECT doc_id, i, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS c FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE c = 13),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT win.doc_id, i + j AS i FROM win JOIN first USING (s), range(0, 13) t(j) WHERE m < win.doc_id),
kept AS (SELECT w.doc_id, count(*) AS n, count(g.i) AS gone, string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS text FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k USING (doc_id)"""

OP7 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS f FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.f) = len(c.f) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

OP8 = f"""WITH RECURSIVE words AS ({WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS c, count(*) OVER (PARTITION BY doc_id) AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, c, s FROM win WHERE c = 4 OR (n < 4 AND i = 1)), size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.c = b.c AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS far FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.far = e.a),
part AS (SELECT node, min(far) AS m FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(part.m, d.doc_id) AS component_id FROM documents d LEFT JOIN size ON size.doc_id = d.doc_id LEFT JOIN part ON part.node = d.doc_id"""

OP12 = r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS a FROM word GROUP BY ALL HAVING count(DISTINCT row) >= 3), size AS (SELECT lang, count(*) AS v, sum(a) AS n FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d), cnt AS (SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN kept USING (lang, term) GROUP BY ALL), tot AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
cell AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // (coalesce(tot.n, 0) + v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (a + 1) // (size.n + v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN size USING (lang) LEFT JOIN tot ON g.lang = tot.lang AND g.source = tot.source LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM cell x JOIN cell y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM cell WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 200"""

OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size, first_value(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)"""

ORACLES = {"op4_substring_recompression": OP4, "op7_topk_pivot_table": OP7, "op8_ngram_jaccard_product": OP8, "op12_source_divergence": OP12, "op13_exact_dedup_runs": OP13}
