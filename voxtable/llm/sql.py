"""DuckDB SQL for the queries that SQL can express, independent of the operators."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Components by spreading the least id over links.
REACH = """
reach(id, root) AS (
    SELECT id, id FROM ids
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id WHERE reach.root < links.b),
parts AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
lines AS (
    SELECT *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 AS size FROM turns),
whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
           coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss, sum(size)::BIGINT AS formatted_chars
    FROM lines GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole"""

EMBEDDING = f"""
WITH RECURSIVE v AS (
    SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id AND len(p.e) = len(q.e)
    WHERE list_dot_product(p.e, q.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(q.e, q.e))) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {REACH},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM parts LEFT JOIN counts ON a = id"""

QUALITY = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM docs),
grams AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM wins),
again AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM grams JOIN again USING (doc_id, g)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
    SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
total AS (SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum(f) / sum(n) AS m, sum(n) - sum(n * n)::DOUBLE / sum(n) AS free, sum(f * f / n) AS between_hosts FROM hosts),
share AS (SELECT *, least(1.0, greatest(0.0, (between_hosts - n * m * m - (h - 1) * m * (1 - m)) / free / nullif(m * (1 - m), 0))) AS s FROM total),
prior AS (SELECT m, CASE WHEN h < 2 OR m <= 0 OR m >= 1 OR free <= 0 THEN 1.0 WHEN s > 0 THEN least(n, greatest(1.0, (1 - s) / s)) ELSE n END AS k FROM share),
verdict AS (SELECT source, (f + m * k) / (hosts.n + k) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(host_rate, 9) AS host_rate, coalesce(host_rate > 0.5, false) AS host_rejected,
       NOT base_failed AND NOT coalesce(host_rate > 0.5, false) AS kept
FROM judged LEFT JOIN verdict USING (source)"""

MINHASH = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pair_counts AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM sets p JOIN sets q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pair_counts JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ids AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM parts LEFT JOIN sizes ON doc_id = id"""

SUBSTRING = rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs)),
firsts AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM wins JOIN firsts USING (h) WHERE d < doc_id) GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) FILTER (NOT list_contains(ks, k - 1)) AS n FROM (SELECT doc_id, ks, unnest(ks) AS k FROM gone) GROUP BY doc_id),
left_words AS (SELECT doc_id, len(w) AS n, coalesce(len(ks), 0) AS r, CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END AS kept FROM docs LEFT JOIN gone USING (doc_id))
SELECT doc_id, left_words.n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256, coalesce(spans.n, 0)::BIGINT AS n_intervals
FROM left_words LEFT JOIN spans USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
sized AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best <> page_id THEN best END AS refers_to FROM sized"""

NEGATIVES = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT p.id AS a, q.id AS b, p.label = q.label AS same, list_dot_product(p.e, q.e)::BIGINT AS score
    FROM v p JOIN v q ON p.id <> q.id AND len(p.e) = len(q.e) WHERE p.id % 100 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM pairs WHERE same),
asked AS (SELECT a, b AS positive_id, score AS positive_score FROM best WHERE place <= 5),
found AS (
    SELECT a AS anchor_id, positive_id, row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, b)::INTEGER AS rank, b AS negative_id, positive_score, score AS negative_score
    FROM asked JOIN pairs USING (a) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM found WHERE rank <= 10"""

SQL = {"op1_chat_format": CHAT, "op2_embedding_dedup": EMBEDDING, "op3_quality_rules": QUALITY, "op5_minhash": MINHASH,
       "op7_substring_dedup": SUBSTRING, "op8_warc": WARC, "op13_hard_negatives": NEGATIVES}
