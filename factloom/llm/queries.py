"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from factloom.llm import centroids, decontaminate, embeddings, infill, jaccard, language, licenses, packing, quality_rules, secrets, suffixes, toxicity, urls

QUERIES = {
    "op1_packing": packing.op1,
    "op2_language_id": language.op2,
    "op3_toxicity": toxicity.op3,
    "op4_ngram_jaccard_join": jaccard.op4,
    "op5_license_scans": licenses.op5,
    "op6_embedding_dedup": embeddings.op6,
    "op7_benchmark_decontamination": decontaminate.op7,
    "op8_suffix_dedup": suffixes.op8,
    "op9_secret_scans": secrets.op9,
    "op10_url_filters": urls.op10,
    "op11_centroid_clustering": centroids.op11,
    "op12_quality_rules": quality_rules.op12,
    "op13_fill_in_middle": infill.op13,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
NOT_SPACES = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": centroids.sql(),
    "op13_fill_in_middle": infill.SQL,
    "op4_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {NOT_SPACES}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT id AS doc_id, COALESCE(MAX(n), 0) AS n_shingles, MIN(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY id""",
    "op7_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {LETTERS}) AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED}, {LETTERS}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) x),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) ks WHERE len(w) >= k) x),
h AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, t)),
c AS (SELECT doc_id, COUNT(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h) x GROUP BY doc_id),
m AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) x GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op8_suffix_dedup": """WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
g AS (SELECT doc_id, i, md5_number(substr(t, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, t, unnest(range(0, length(t) // 2 - 99)) AS i FROM x WHERE length(t) >= 200) y),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM g) y WHERE rn > 1),
s AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 100 AS z FROM (SELECT doc_id, i, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i <= LAG(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM r) y) y GROUP BY doc_id, span),
k AS (SELECT doc_id, string_agg(substr(t, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(t), 2 * MAX(z) + 1) AS kept, SUM(z - a) AS gone, COUNT(*) AS n FROM (SELECT s.*, COALESCE(LAG(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s) y JOIN x USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(t) // 2 AS n_bytes, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed, COALESCE(n, 0) AS n_spans, sha256(unhex(COALESCE(kept, t))) AS kept_sha256 FROM x LEFT JOIN k USING (doc_id)""",
}
