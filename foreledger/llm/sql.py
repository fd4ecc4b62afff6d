"""DuckDB SQL for those corpus queries that SQL can express."""

from foreledger.llm.warc import BASE32

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

CHAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), true) AS opens
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('text')}) + CASE WHEN opens
    THEN length({_ESCAPED.format('role')}) + length('<|role|><|text|><|end|>') ELSE length('<|next|>') END) AS BIGINT)
    AS formatted_chars
FROM placed GROUP BY conv_id
"""

WARC = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
facts AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex,
    max(page_id) OVER (PARTITION BY body) AS owner FROM bodies),
words AS (
  SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(hex, CAST(1 + 5 * k AS INTEGER), 5) AS INTEGER)) AS w
  FROM facts)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('{BASE32}', CAST(1 + ((w[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM words
"""

DECONTAMINATE = """
WITH told AS (
  SELECT 'd' AS kind, doc_id AS id, md5(coalesce(text, '')) AS version,
    regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, md5(coalesce(text, '')), regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')
  FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, version, array_to_string(w[k:k + 4], ' ') AS shingle
  FROM (SELECT kind, id, version, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM told WHERE len(w) > 0)),
items AS (SELECT id, version, shingle, count(*) OVER (PARTITION BY id, version) AS n FROM shingles WHERE kind = 'i')
SELECT DISTINCT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM (SELECT d.id AS doc_id, d.version AS dv, i.id AS item_id, i.version AS iv, any_value(n) AS n_item,
    count(*) AS n_shared
  FROM shingles d JOIN items i USING (shingle) WHERE d.kind = 'd' GROUP BY 1, 2, 3, 4)
WHERE n_shared / n_item >= 0.8
"""

IMPORTANCE = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
told AS (
  SELECT r, text FROM docs UNION ALL SELECT NULL, text FROM benchmark),
words AS (
  SELECT r, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS w
  FROM told WHERE text IS NOT NULL),
counts AS (SELECT r, w, count(*) AS n FROM words GROUP BY r, w),
bytes AS (
  SELECT w, list_transform(range(strlen(w)), lambda k: CAST('0x' || substr(hex(w), CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT w FROM words)),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST(1 + (xor(c, x) & 255) AS INTEGER)])),
    4294967295) % 10000 AS bucket FROM bytes, crc_table),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (r IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (r IS NULL), 0) AS t
  FROM counts JOIN buckets USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM totals) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM totals) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM totals),
weights AS (
  SELECT r, sum(n) AS n_features, sum(n * gain) AS weight
  FROM counts JOIN buckets USING (w) JOIN gains USING (bucket) WHERE r IS NOT NULL GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
      '2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN weights USING (r)),
drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM drawn) THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (r)
"""

EMBEDDINGS = """
WITH RECURSIVE told AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT r, label, e, sqrt(list_dot_product(e, e)) AS norm FROM told
  WHERE label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: isfinite(x))) = len(e)
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT r AS a, r AS b FROM told UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN told ON told.r = reach.b GROUP BY a),
counts AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept
FROM told JOIN named USING (r) LEFT JOIN counts USING (r)
"""

FILL_IN_MIDDLE = """
WITH told AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
drawn AS (
  SELECT *, list_transform(range(4), lambda k: CAST('0x' || substr(hex, CAST(1 + 8 * k AS INTEGER), 8) AS BIGINT)) AS h
  FROM told),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90
      THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, substr(body, 1, a) AS prefix, substr(body, a + 1, b - a) AS middle, substr(body, b + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""

SQL = {"op7_decontaminate": DECONTAMINATE, "op5_chat_format": CHAT, "op9_warc_archive": WARC, "op11_importance_resampling": IMPORTANCE,
       "op12_embedding_duplicates": EMBEDDINGS, "op13_fill_in_middle": FILL_IN_MIDDLE}
