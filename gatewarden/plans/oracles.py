"""The SQL that each query must agree with, for DuckDB over the same tables."""

from __future__ import annotations

from gatewarden.operators.vocabulary import PREDEFINED

_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_ID = f"""
  SELECT page_id, url, 'GET|' || replace(trim(lower(regexp_extract(url, {_URL}, 3)), '/'), '/', '_') || '|' ||
         array_to_string(list_sort(list_distinct(list_transform(
           list_filter(string_split(regexp_extract(url, {_URL}, 4), '&'), lambda x: regexp_matches(x, '^[^=]*=.')),
           lambda x: string_split(x, '=')[1]))), '_') AS identifier
  FROM pages"""
_REQUESTS = "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'HEAD' END AS method, url, '' AS body FROM pages"
_WORDS = "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS words FROM documents"
_VOCAB = f"""
  SELECT token, 1 + row_number() OVER (ORDER BY n DESC, token) AS id
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM ({_WORDS})) GROUP BY token) QUALIFY id <= 501"""
_PARTS = f"""
  SELECT id, method, regexp_extract(url, {_URL}, 3) AS path,
         list_filter(string_split(regexp_extract(url, {_URL}, 4), '&'), lambda x: trim(x) <> '') AS q
  FROM ({_REQUESTS})"""
_KNN = """
  SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank
  FROM (SELECT q.vec_id AS query_id, s.vec_id AS vec_id,
               round(sqrt(list_sum(list_transform(list_zip(q.embedding, s.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))), 9) AS distance
        FROM embeddings q, embeddings s WHERE q.vec_id % 20 = 0)
  QUALIFY rank <= 6"""
_PREDICTED = """
  SELECT label AS y_true, CAST(CASE WHEN vec_id % 7 = 0 THEN 10 WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS y_pred
  FROM embeddings"""
_LABELS = ("normal", "SQL Injection", "Forced Browsing", "Path Traversal", "Cross-site Scripting", "XML Injection", "OS Command Injection", "LDAP Injection", "Remote Code Execution", "Others")
_NAMES = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"
_PAYLOADS = "SELECT page_id AS idx, url AS text FROM pages"


def _clusters(rows: str) -> str:
    """Clusters of rows (g, idx, text): a round takes each group's first edge in order of (d, i, j) and drops those of its j."""
    return f"""
      WITH RECURSIVE p AS (SELECT * FROM ({rows}) WHERE text <> ''),
      e AS (SELECT a.g, a.idx AS i, b.idx AS j, levenshtein(a.text, b.text) AS d FROM p a JOIN p b ON a.g = b.g AND a.idx < b.idx
            WHERE length(a.text) / length(b.text) BETWEEN 0.667 AND 1.5 AND levenshtein(a.text, b.text) < (length(a.text) + length(b.text)) / 4),
      rounds AS (
        SELECT 0 AS k, g, i, j, d FROM e
        UNION ALL
        SELECT k + 1, g, i, j, d FROM (SELECT *, first_value(j) OVER (PARTITION BY g ORDER BY d, i, j) AS gone FROM rounds) WHERE i <> gone AND j <> gone),
      up AS (SELECT i AS into_, j AS node FROM rounds QUALIFY row_number() OVER (PARTITION BY k, g ORDER BY d, i, j) = 1),
      chase AS (
        SELECT node, into_ AS goal FROM up
        UNION ALL
        SELECT c.node, u.into_ FROM chase c JOIN up u ON u.node = c.goal),
      top AS (SELECT node, goal FROM chase WHERE goal NOT IN (SELECT node FROM up))
      SELECT g, idx, coalesce(goal, idx) AS cluster FROM p LEFT JOIN top ON node = idx"""


_SIZE_BINS = "[[1, 1], [2, 2], [3, 5], [6, 10], [11, 20], [21, 50], [51, 100], [101, NULL]]"
_SHORT = {"Path Traversal": "traversal", "Cross-site Scripting": "xss", "XML Injection": "xxe", "Remote Code Execution": "rce"}
_CASES = " ".join(f"WHEN contains(t, '{_SHORT.get(x, x).lower()}') OR contains(t, '{x.lower()}') THEN {i}" for i, x in enumerate(_LABELS))

_IS_HEX = "regexp_matches(token, '^(0x)?[0-9a-f]{8,}$')"
_IS_BASE = "(regexp_matches(token, '^[0-9a-z]{12,}$') AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[a-z]'))"
_IS_CODE = f"({_IS_HEX} OR {_IS_BASE})"
_FIXED = "[" + ", ".join(f"'{t}'" for t in PREDEFINED) + "]"

_KIND = """CASE WHEN contains(t, '<') THEN 'Cross-site Scripting' WHEN contains(t, '''') OR contains(lower(t), ' or ') THEN 'SQL Injection'
           WHEN contains(t, '../') THEN 'Path Traversal' ELSE 'normal' END"""
_RULED = f"""
  SELECT task_id, 'completed' AS state, CAST(list_position({_NAMES}, kind) - 1 AS INTEGER) AS y_pred, kind AS attack_type
  FROM (SELECT page_id AS task_id, {_KIND} AS kind
        FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || ''' or 1=1' WHEN 1 THEN url || '/../../etc' WHEN 2 THEN url || '<b>' ELSE url END AS t FROM pages))"""
_LEAST = """
  SELECT topic, partition, lag
  FROM (SELECT event_type AS topic, user_id % 5 AS partition, CASE WHEN min(event_id) - 7 >= 0 THEN greatest(0, max(event_id) - min(event_id) + 6) ELSE 0 END AS lag
        FROM events GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY lag, partition) = 1"""
SQL = {
    "structure_identifier_counts": f"SELECT identifier, count(*) AS requests FROM ({_ID}) GROUP BY identifier",
    "param_values_by_structure": f"""
      WITH p AS (SELECT unnest(list_filter(string_split(regexp_extract(url, {_URL}, 4), '&'), lambda x: regexp_matches(x, '^[^=]*=.'))) AS kv FROM pages)
      SELECT string_split(kv, '=')[1] AS param, count(*) AS n,
             string_agg(DISTINCT regexp_extract(kv, '^[^=]*=(.*)$', 1), ',' ORDER BY regexp_extract(kv, '^[^=]*=(.*)$', 1)) AS distinct_values
      FROM p GROUP BY 1""",
    "unknown_structure_split": f"""
      WITH r AS ({_ID}), k AS (SELECT DISTINCT identifier FROM r WHERE page_id % 2 = 0)
      SELECT CASE WHEN k.identifier IS NULL THEN 'unknown_structure' ELSE 'known' END AS verdict, count(*) AS n
      FROM r LEFT JOIN k USING (identifier) GROUP BY 1""",
    "msu_parts": f"""
      SELECT id, array_to_string(parts, ' | ') AS parts, CAST(len(parts) AS BIGINT) AS n FROM (
        SELECT id, list_concat(list_concat([method], list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: '/' || x)), q) AS parts
        FROM ({_PARTS}))""",
    "msu_parts_whole_path": f"""
      SELECT id, array_to_string(parts, ' | ') AS parts, CAST(len(parts) AS BIGINT) AS n FROM (
        SELECT id, list_concat(list_filter([method, path], lambda x: trim(x) <> ''), q) AS parts FROM ({_PARTS}))""",
    "word_tokens_freq": r"""
      SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[,;+/=&'':? \t\r\n\f\x0b]+')) AS token FROM documents)
      WHERE token <> '' GROUP BY token HAVING count(*) >= 20""",
    "token_class_counts": f"""
      SELECT CASE WHEN regexp_matches(token, '^[0-9a-f]{{8,}}$') THEN 'hex' WHEN regexp_matches(token, '^[0-9]+$') THEN 'bas' ELSE 'word' END AS kind,
             count(*) AS n, count(DISTINCT token) AS distinct_tokens
      FROM (SELECT unnest(words) AS token FROM ({_WORDS})) GROUP BY 1""",
    "vocab_topk_ids": f"SELECT token, CAST(id AS BIGINT) AS id FROM ({_VOCAB})",
    "sequence_encode_pad": f"""
      WITH v AS ({_VOCAB}), m AS (SELECT map_from_entries(list({{'k': token, 'v': CAST(id AS BIGINT)}})) AS ids FROM v), w AS ({_WORDS})
      SELECT doc_id, array_to_string(list_concat(list_transform(words[1:16], lambda x: coalesce(ids[x], 1)), list_transform(range(greatest(0, 16 - len(words))), lambda x: 0)), ' ') AS ids
      FROM w, m""",
    "sequence_counts_dedup": f"""
      WITH w AS (SELECT doc_id, lang, list_transform(words, lambda x: CASE WHEN length(x) > 4 THEN '__other__' ELSE x END) AS t FROM ({_WORDS}) JOIN documents USING (doc_id)),
      s AS (SELECT doc_id, lang, array_to_string(list_transform(list_filter(list_zip(t, list_concat([NULL], t)), lambda p: p[1] IS NOT NULL AND NOT (p[1] = '__other__' AND p[2] IS NOT DISTINCT FROM '__other__')), lambda p: p[1]), ' ') AS seq FROM w)
      SELECT seq, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids,
             array_to_string(list(lang ORDER BY doc_id)[1:5], ',') AS samples
      FROM s GROUP BY seq""",
    "value_shape_counts": r"""
      SELECT regexp_replace(regexp_replace(regexp_replace(token, '\p{L}', 'A', 'g'), '\p{Nd}', 'N', 'g'), '[^AN]', 'S', 'g') AS shape, count(*) AS n
      FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\r\n\f\x0b]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1""",
    "label_histogram": f"SELECT label, count(*) AS n, coalesce(({_NAMES})[label + 1], 'unknown') AS name FROM embeddings GROUP BY label",
    "methods_rollup": f"SELECT method, count(*) AS requests FROM ({_REQUESTS}) GROUP BY ROLLUP (method)",
    "merge_vocab_union": "SELECT DISTINCT token FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS token FROM documents)",
    "embedding_merge_antijoin": """
      WITH r AS (SELECT 'w' || vec_id AS word, vec_id AS id FROM embeddings), a AS (SELECT * FROM r WHERE id % 3 <> 0),
      b AS (SELECT * FROM r WHERE word NOT IN (SELECT word FROM a))
      SELECT word, id FROM a UNION ALL SELECT word, (SELECT max(id) FROM a) + row_number() OVER (ORDER BY id) FROM b""",
    "knn_top6": f"SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM ({_KNN})",
    "knn_vote": f"""
      WITH v AS (SELECT query_id, label, count(*) AS n FROM ({_KNN}) k JOIN embeddings e ON e.vec_id = k.vec_id WHERE k.vec_id <> query_id GROUP BY 1, 2),
      p AS (SELECT query_id, label AS y_pred FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1)
      SELECT query_id, e.label AS y_true, y_pred FROM p JOIN embeddings e ON e.vec_id = query_id""",
    "confusion_matrix": f"""
      SELECT y_true AS y, {", ".join(f"count(*) FILTER (y_pred = {k}) AS p{k}" for k in range(10))}, count(*) AS total,
             {", ".join(f"round(count(*) FILTER (y_pred = {k}) / count(*), 4) AS r{k}" for k in range(10))}
      FROM ({_PREDICTED}) WHERE y_pred BETWEEN 0 AND 9 AND y_true BETWEEN 0 AND 9 GROUP BY y_true""",
    "classification_report": f"""
      WITH d AS ({_PREDICTED}), l AS (SELECT unnest(range(10)) AS k),
      c AS (SELECT k, count(*) FILTER (y_true = k AND y_pred = k) AS t, count(*) FILTER (y_pred = k) AS p, count(*) FILTER (y_true = k) AS y FROM l, d GROUP BY k),
      m AS (SELECT k, CASE WHEN p > 0 THEN t / p ELSE 0.0 END AS a, CASE WHEN y > 0 THEN t / y ELSE 0.0 END AS b, y FROM c),
      f AS (SELECT CAST(k AS VARCHAR) AS label, a, b, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0.0 END AS f1, y FROM m)
      SELECT label, round(a, 4) AS precision, round(b, 4) AS recall, round(f1, 4) AS f1, CAST(y AS BIGINT) AS support FROM f
      UNION ALL SELECT 'macro avg', round(avg(a), 4), round(avg(b), 4), round(avg(f1), 4), CAST(sum(y) AS BIGINT) FROM f
      UNION ALL SELECT 'weighted avg', round(sum(a * y) / sum(y), 4), round(sum(b * y) / sum(y), 4), round(sum(f1 * y) / sum(y), 4), CAST(sum(y) AS BIGINT) FROM f""",
    "binary_accuracy": f"SELECT round(avg(CASE WHEN (y_true > 0) = (y_pred > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (y_pred = 10) AS errors, count(*) AS total FROM ({_PREDICTED})",
    "attack_label_extract": f"""
      WITH a AS (SELECT conv_id, turn, lower(text || ' Final Classification: ' || (list_concat({_NAMES}, ['no idea', 'resource leak']))[1 + (conv_id + turn) % 12]) AS low FROM conversations),
      t AS (SELECT conv_id, turn, CASE WHEN contains(low, 'final classification') THEN substr(low, instr(low, 'final classification') + 20)
                                       WHEN contains(low, 'final answer:') THEN substr(low, instr(low, 'final answer:') + 13) ELSE low END AS t FROM a),
      y AS (SELECT conv_id, turn, CASE {_CASES} ELSE 10 END AS y_pred FROM t)
      SELECT conv_id, turn, y_pred, coalesce(({_NAMES})[y_pred + 1], 'unknown') AS prediction_result FROM y""",
    "final_answer_extract": r"""SELECT conv_id, turn, regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS answer FROM conversations""",
    "prompt_split": r"""
      SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN length(role) + 1 ELSE 0 END AS BIGINT) AS system_chars,
             sha256(CASE WHEN turn % 2 = 0 THEN '# Input request' || chr(10) || text ELSE text END) AS user_sha256
      FROM conversations""",
    "length_histogram": """
      WITH b AS (SELECT * FROM (VALUES (0, '0-4000'), (1, '4001-8600'), (2, '8601-10000'), (3, '10001-12000'), (4, '12000+')) AS t(k, bin)),
      c AS (SELECT CASE WHEN length(text) >= 12000 THEN 4 WHEN length(text) >= 10000 THEN 3 WHEN length(text) >= 8600 THEN 2 WHEN length(text) >= 4000 THEN 1 ELSE 0 END AS k, count(*) AS n FROM documents GROUP BY 1)
      SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (k)""",
    "length_totals": "SELECT min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS average, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations",
    "error_rate_tumbling": """
      WITH c AS (SELECT date_trunc('hour', ts) AS bin, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
      b AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM c)
      SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""",
    "error_rate_10s": "SELECT time_bucket(INTERVAL 10 SECONDS, ts) AS bin, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "adaptive_bucket": """
      WITH c AS (SELECT date_trunc('day', ts) AS bin, count(*) AS n FROM events GROUP BY 1),
      b AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 DAY)) AS bin FROM c)
      SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""",
    "dedup_keep_last": """
      SELECT user_id, date_trunc('hour', ts) AS hour, event_type, event_id, ts FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts), event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "row_hash_dedup": "SELECT DISTINCT sha256(CAST(user_id AS VARCHAR) || chr(31) || event_type) AS row_hash FROM events",
    "attack_type_topk": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3",
    "totals": "SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS intercepted FROM events",
    "paged_search": """
      SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents WHERE regexp_matches(text, '(?i)version 3'))
      WHERE place BETWEEN 5 AND 9""",
    "retention_7d": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY event_type",
    "props_json_extract": "SELECT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, count(*) AS n FROM events GROUP BY 1",
    "status_router": """
      SELECT CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN -1 WHEN 'view' THEN NULL ELSE 0 END AS verdict,
             CAST(CASE WHEN user_id % 10 = 0 THEN 0 ELSE 1 END AS INTEGER) AS label, count(*) AS n FROM events GROUP BY 1, 2""",
    "request_lines": f"""
      SELECT id, 'Method: ' || method || ' URL: ' || url || ' Body: ' AS prompt, 'Method: ' || method || chr(10) || 'URL: ' || url AS lines,
             trim(url) AS content, method || ' ' || trim(url) AS raw FROM ({_REQUESTS})""",
    "url_split": f"""
      SELECT page_id, lower(regexp_extract(url, {_URL}, 1)) AS scheme, regexp_extract(url, {_URL}, 2) AS netloc, regexp_extract(url, {_URL}, 3) AS path,
             regexp_extract(url, {_URL}, 4) AS query, regexp_extract(url, {_URL}, 5) AS fragment FROM pages""",
    "url_word_tokens": r"""
      WITH t AS (SELECT list_filter(regexp_split_to_array(url, '[,;+/=&'':?\s]+'), lambda x: x <> '') AS t FROM pages),
      u AS (SELECT unnest(t) AS token, unnest(range(len(t))) AS pos FROM t)
      SELECT token, count(*) AS n, min(pos) AS first_pos FROM u GROUP BY token""",
    "similar_pairs": f"""
      WITH p AS (SELECT * FROM ({_PAYLOADS}) WHERE text <> '')
      SELECT a.idx AS i, b.idx AS j, CAST(levenshtein(a.text, b.text) AS BIGINT) AS d FROM p a JOIN p b ON a.idx < b.idx
      WHERE length(a.text) / length(b.text) BETWEEN 0.667 AND 1.5 AND levenshtein(a.text, b.text) < (length(a.text) + length(b.text)) / 4""",
    "containment_bucket": """
      WITH s AS (SELECT text AS s FROM benchmark UNION SELECT substr(text, 5, 40) FROM benchmark)
      SELECT DISTINCT a.s FROM s a JOIN s b ON a.s <> b.s AND contains(b.s, a.s) WHERE a.s <> ''""",
    "stage_resume": "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 2 <> 0",
    "stream_vs_batch_counts": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "latest_event": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "request_heads": f"SELECT id, method, url FROM ({_REQUESTS})",
    "canonical_urls": f"""
      SELECT page_id, lower(regexp_extract(url, {_URL}, 1)) || '://' || lower(regexp_extract(url, {_URL}, 2)) ||
             CASE WHEN regexp_extract(url, {_URL}, 3) = '' THEN '/' ELSE regexp_extract(url, {_URL}, 3) END ||
             CASE WHEN q = '' THEN '' ELSE '?' || q END AS url
      FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, {_URL}, 4), '&'), lambda x: x <> '')), '&') AS q FROM pages)""",
    "body_kinds": "SELECT turn % 3 = 0 AS form, turn % 3 = 1 AS multipart, turn % 2 <> 0 AS named, count(*) AS n FROM conversations GROUP BY ALL",
    "vocabulary_by_class": f"""
      WITH t AS (SELECT token, count(*) AS n FROM (SELECT unnest(words) AS token FROM ({_WORDS})) GROUP BY token)
      SELECT token FROM t WHERE n >= CASE WHEN {_IS_CODE} THEN 3 ELSE 20 END UNION SELECT unnest({_FIXED}) AS token""",
    "placeholder_sequences": f"""
      WITH w AS (SELECT doc_id, unnest(words) AS token, unnest(range(len(words))) AS pos FROM ({_WORDS})),
      v AS (SELECT token FROM w GROUP BY token HAVING count(*) >= 50),
      c AS (SELECT doc_id, pos, CASE WHEN v.token IS NOT NULL THEN w.token WHEN {_IS_HEX.replace("token", "w.token")} THEN '__phex__'
                                     WHEN {_IS_BASE.replace("token", "w.token")} THEN '__pbas__' ELSE '__other__' END AS t FROM w LEFT JOIN v ON v.token = w.token),
      l AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM c)
      SELECT doc_id, sha256(string_agg(t, ' ' ORDER BY pos)) AS seq_sha256 FROM l WHERE NOT (list_contains({_FIXED}, t) AND t IS NOT DISTINCT FROM p) GROUP BY doc_id""",
    "sequence_words": "SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS token FROM conversations",
    "first_pairs": f"""
      WITH p AS (SELECT page_id, string_split(regexp_extract(url, {_URL}, 4) || '&page=9&z=1&z=2', '&') AS q FROM pages),
      u AS (SELECT page_id, unnest(q) AS kv, unnest(range(len(q))) AS pos FROM p),
      f AS (SELECT * FROM u WHERE regexp_matches(kv, '^[^=]*=.') QUALIFY row_number() OVER (PARTITION BY page_id, string_split(kv, '=')[1] ORDER BY pos) = 1)
      SELECT page_id, string_agg(kv, '&' ORDER BY pos) AS pairs FROM f GROUP BY page_id""",
    "json_identifiers": "SELECT 'POST|api_' || event_type || '|' || array_to_string(list_sort(json_keys(props)), '_') AS identifier, count(*) AS n FROM events GROUP BY 1",
    "json_parameters": """
      SELECT 'q' AS param, '1' AS value, count(*) AS n FROM events
      UNION ALL SELECT 'k', json_extract_string(props, '$.k'), count(*) FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 2""",
    "shape_code_lists": r"""
      SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(url, '\p{L}', 'A', 'g'), '\p{Nd}', 'N', 'g'), '[^AN]', 'S', 'g'), ''), lambda c: ascii(c)), ' ') AS codes
      FROM pages""",
    "character_counts": "SELECT hex(c) AS c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1",
    "clean_texts": r"""
      SELECT conv_id, turn, sha256(regexp_replace(t, '[\x00-\x1F\x7F]', '', 'g')) AS string_sha256,
             sha256(trim(regexp_replace(replace(t, '"', ' '), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), ' ')) AS line_sha256
      FROM (SELECT *, '"' || chr(1) || ' ' || text || ' ' || chr(9) || chr(127) || '"' AS t FROM conversations)""",
    "filled_prompts": "SELECT conv_id, turn, sha256(role || ' says: ' || replace(text, '{role}', role) || ' (' || role || ', {other})') AS prompt_sha256 FROM conversations",
    "escaped_patterns": r"""SELECT page_id, replace(regexp_replace('(.*) ' || url, '([\s#$&()*+\-.?\[\\\]^{|}~])', '\\\1', 'g'), '\.\*', '.*') AS pattern FROM pages""",
    "signature_patterns": r"""
      SELECT page_id, s AS signature, CAST(length(replace(s, '.*', '')) AS BIGINT) AS n
      FROM (SELECT page_id, regexp_replace(url, '([\s#$&()*+\-.?\[\\\]^{|}~])', '\\\1', 'g') || '.*x.*.*y' AS s FROM pages)""",
    "aligned_characters": f"""
      WITH p AS (SELECT id, list_concat(list_concat([method], list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: '/' || x)), q) AS parts FROM ({_PARTS}))
      SELECT id, CAST(len(parts) AS BIGINT) AS parts, array_to_string(string_split(array_to_string(parts, ''), ''), ' ') AS tokens FROM p""",
    "aligned_words": f"""
      WITH p AS (SELECT id, list_concat(list_concat([method], list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: '/' || x)), q) AS parts FROM ({_PARTS}))
      SELECT id, array_to_string(list_filter(regexp_split_to_array(array_to_string(parts, ' '), '[,;+/=&'':?\\s]+'), lambda x: x <> ''), ' ') AS tokens FROM p""",
    "parts_with_headers": f"""
      SELECT id, array_to_string(list_concat(list_concat(list_concat([method], list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: '/' || x)), q), ['Host: h', 'X-Id: ' || id, 'a=1', 'b=2']), ' | ') AS parts
      FROM ({_PARTS})""",
    "custom_bodies": "SELECT conv_id, turn, 'role: ' || role || '|turn:' || turn AS parts FROM conversations",
    "identifier_codec": "SELECT page_id, 'GET__PIPE__' || replace(replace(url, '|', '__PIPE__'), '/', '__SLASH__') AS code, 'GET|' || url AS identifier FROM pages",
    "event_lags": """
      SELECT event_type, CAST(sum(CASE WHEN user_id % 60 - 5 >= 0 THEN greatest(0, event_id % 100 - (user_id % 60 - 5) - 1) ELSE 0 END) AS BIGINT) AS lag,
             round(avg(1 / (1 + exp(-value / 100))), 6) AS mean
      FROM events GROUP BY event_type""",
    "union_rate": """
      WITH t AS (SELECT ts FROM events WHERE event_type = 'error' UNION ALL SELECT ts FROM events WHERE event_type = 'view' AND user_id % 3 <> 0),
      c AS (SELECT date_trunc('hour', ts) AS bin, count(*) AS n FROM t GROUP BY 1),
      b AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM c)
      SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)""",
    "positional_join": """
      SELECT a.vec_id, b.label AS y, b.vec_id AS other FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings) a
      JOIN (SELECT *, row_number() OVER (ORDER BY vec_id DESC) AS k FROM embeddings) b USING (k)""",
    "reportable_labels": "SELECT label, count(*) AS n FROM embeddings WHERE label NOT IN (0, 9, 10) GROUP BY label",
    "clusters_without_outlier": """
      WITH r AS (SELECT page_id % 25 AS cluster, page_id AS idx, url AS text FROM pages),
      s AS (SELECT a.cluster, a.idx, sum(levenshtein(a.text, b.text)) AS d, count(*) AS n FROM r a JOIN r b USING (cluster) GROUP BY ALL),
      w AS (SELECT cluster, idx FROM s WHERE n > 5 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d DESC, idx) = 1)
      SELECT cluster, idx FROM r ANTI JOIN w USING (cluster, idx)""",
    "cluster_medoids": """
      WITH r AS (SELECT page_id % 25 AS cluster, page_id AS idx, url AS text FROM pages),
      s AS (SELECT a.cluster, a.idx, sum(levenshtein(a.text, b.text)) AS d FROM r a JOIN r b USING (cluster) GROUP BY ALL)
      SELECT cluster, idx FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d, idx) = 1""",
    "rule_fields": """
      SELECT page_id, 'ARGS_GET:p' || page_id || CASE WHEN page_id % 2 = 0 THEN '|ARGS|REQUEST_BODY|REQUEST_FILENAME|ARGS|REQUEST_BODY|REQUEST_URI' ELSE '|REQUEST_FILENAME|ARGS_POST:id|REQUEST_URI' END AS targets FROM pages""",
    "list_merge": "SELECT user_id AS key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id % 3, event_id) AS ids FROM events GROUP BY user_id",
    "cluster_assign": f"SELECT idx, cluster FROM ({_clusters('SELECT 0 AS g, * FROM (' + _PAYLOADS + ')')})",
    "cluster_size_histogram": f"""
      WITH s AS (SELECT cluster, count(*) AS size FROM ({_clusters('SELECT 0 AS g, * FROM (' + _PAYLOADS + ')')}) GROUP BY cluster),
      b AS (SELECT unnest({_SIZE_BINS}) AS b)
      SELECT CASE WHEN b[2] IS NULL THEN b[1] || '+' ELSE b[1] || '-' || b[2] END AS bin, count(size) AS n
      FROM b LEFT JOIN s ON size >= b[1] AND (b[2] IS NULL OR size <= b[2]) GROUP BY b""",
    "task_clusters": f"SELECT g AS task, idx, cluster FROM ({_clusters('SELECT idx % 4 AS g, * FROM (' + _PAYLOADS + ')')})",
    "two_stage_classification": f"""
      SELECT {_KIND} AS attack_type, count(*) AS n
      FROM (SELECT CASE page_id % 4 WHEN 0 THEN url || ''' or 1=1' WHEN 1 THEN url || '/../../etc' ELSE replace(url, '''', '') END AS t FROM pages) GROUP BY 1""",
    "direct_classification": _RULED,
    "one_stage_classification": _RULED,
    "realtime_attacks": f"SELECT y_pred, count(*) AS n FROM ({_PREDICTED}) WHERE y_pred NOT IN (0, 9, 10) GROUP BY y_pred",
    "chat_prompts": """
      SELECT conv_id, turn, sha256('<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || coalesce(role, '') ||
             '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || coalesce(text, '') ||
             '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) AS prompt_sha256 FROM conversations""",
    "message_inputs": "SELECT conv_id, turn, sha256(role || chr(10) || text) AS input_sha256, length(role) + length(text) AS n FROM conversations",
    "turn_tokens": """
      WITH t AS (SELECT len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS n FROM conversations)
      SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS average, CAST(sum(n) AS BIGINT) AS total FROM t""",
    "abnormal_rows": """
      SELECT conv_id, turn, sha256(text) AS text_sha256, 'others' AS type FROM conversations
      WHERE turn % 2 = 0 AND conv_id % 3 <> 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""",
    "detection_counters": """
      WITH r AS (SELECT event_type IN ('error', 'click') AS p, event_type = 'click' AS u, user_id % 3 <> 0 AS b FROM events)
      SELECT count(*) FILTER (p AND b) AS tp, count(*) FILTER (p AND NOT b) AS fp, count(*) FILTER (NOT p AND NOT b) AS tn,
             count(*) FILTER (NOT p AND b) AS fn, count(*) FILTER (u) AS unknown, count(*) AS total FROM r""",
    "least_lag": _LEAST,
    "outgoing_messages": f"SELECT 'error' AS topic, CAST(event_id AS VARCHAR) AS key, props AS value, CAST((SELECT partition FROM ({_LEAST}) WHERE topic = 'error') AS INTEGER) AS partition FROM events WHERE event_type = 'error'",
    "time_stamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events",
    "rate_axis": "SELECT round(max(n) * 1.2::DOUBLE, 6) AS bound FROM (SELECT count(*) AS n FROM events WHERE event_type = 'error' GROUP BY date_trunc('hour', ts))",
    "unescaped_texts": r"SELECT conv_id, turn, sha256('Aé\u00zz' || text || '你') AS body_sha256 FROM conversations",
    "unquoted_urls": "SELECT page_id, 'A ' || url || ' ' AS part FROM pages",
}
