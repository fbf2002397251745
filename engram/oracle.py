"""The same queries as SQL over the driver's test tables, for a DuckDB check.

Written on their own from the meaning of each query; shared table expressions
mirror FIXTURES.md, part B.
"""

from __future__ import annotations

_MEM = """
mem AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, CAST(vec_id % 5 AS VARCHAR) AS user_id,
    'ns' || label AS namespace, label, '<m> & ' || vec_id AS content,
    CAST(embedding AS DOUBLE[]) AS e,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS created_at,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) + to_hours(vec_id % 7) AS updated_at
  FROM embeddings)"""

_WS = r"[\t\n\x{0B}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _normal(column: str) -> str:
    return f"nfc_normalize(trim(regexp_replace({column}, '{_WS}', ' ', 'g'), ' '))"


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


_REQ = f"""
req AS (
  SELECT doc_id AS seq, CAST(doc_id % 7 AS VARCHAR) AS user_id,
    CASE WHEN doc_id % 7 < 5 THEN 'free' ELSE 'pro' END AS tier, lang AS namespace, text AS content,
    sha256({_normal('text')}) AS content_hash,
    '{{"source":"' || source || '","n_chars":' || n_chars || '}}' AS metadata
  FROM documents)"""

_STORED = """
stored AS (
  SELECT CAST(r.seq AS VARCHAR) AS id, r.* FROM req r WHERE r.seq IN (SELECT doc_id FROM labels))"""

_USE = """
use AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, CAST(user_id AS VARCHAR) AS user_id,
    CAST(user_id * 10 + event_id % 2 AS VARCHAR) AS api_key_id,
    CASE event_type WHEN 'view' THEN 'recall' WHEN 'error' THEN 'recall' WHEN 'signup' THEN 'remember'
      WHEN 'click' THEN 'list_memories' WHEN 'purchase' THEN 'update_memory' END AS tool_name,
    CAST(round(value) AS BIGINT) AS latency_ms, event_type <> 'error' AS success,
    CASE WHEN event_type = 'error' THEN 'internal_error' END AS error_code, ts AS occurred_at
  FROM events)"""

_USERS = """
people AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS n, c_name || '@example.com' AS email,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'starter' WHEN 'AUTOMOBILE' THEN 'pro' WHEN 'FURNITURE' THEN 'team'
      ELSE 'free' END AS tier, 'cus_' || c_custkey AS customer_id
  FROM customer)"""

_KEYS = """
ks AS (
  SELECT CAST(p.n * 10 + g.i AS VARCHAR) AS id, p.n * 10 + g.i AS num, p.id AS user_id,
    'label ' || g.i AS label, CASE WHEN g.i = 0 THEN p.tier ELSE '' END AS tier, p.tier AS user_tier,
    CASE WHEN g.i = 1 AND p.n % 4 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS revoked_at
  FROM people p, (SELECT 0 AS i UNION ALL SELECT 1) g)"""

_BILL = """
bill AS (
  SELECT 'evt_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, o_orderkey,
    CASE o_orderstatus WHEN 'O' THEN 'customer.subscription.created' WHEN 'P' THEN 'customer.subscription.updated'
      ELSE 'customer.subscription.deleted' END AS event_type,
    o_orderdate AS received_at, 'cus_' || o_custkey AS customer_id, o_orderpriority AS price_id
  FROM orders)"""

_PRICES = """
prices AS (
  SELECT * FROM (VALUES ('1-URGENT', 'team'), ('2-HIGH', 'pro'), ('3-MEDIUM', 'starter'), ('5-LOW', 'free'))
    AS t(price_id, new_tier))"""


def _with(*tables: str) -> str:
    return "WITH RECURSIVE " + ",".join(tables)


def _pairs(requests: str, join: str, threshold: str, k: str, where: str = "TRUE") -> str:
    """Ranked matches of each request."""
    return f"""
scored AS (
  SELECT q.request_id, m.*, list_cosine_similarity(m.e, q.qe) AS sim, {k} AS k
  FROM {requests} q JOIN mem m ON m.user_id = q.quser AND {join} WHERE {where}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, created_at, id) AS rank
  FROM scored WHERE sim >= {threshold}),
best AS (SELECT * FROM ranked WHERE rank <= k)"""


_Q = """
q AS (SELECT vec_id AS request_id, user_id AS quser, namespace AS qspace, label AS qlabel, e AS qe FROM mem)"""
_SAME = "m.namespace = q.qspace"
_SIM = "round(least(1.0, greatest(0.0, sim)), 6) AS similarity"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["recall_batch"] = (
    _with(_MEM, _Q, _pairs("q", _SAME, "0.0", "5"))
    + f" SELECT request_id, rank, id, content, {_SIM}, namespace, {_iso('created_at')} AS created_at FROM best"
)
ORACLE_SQL["recall_batch_blocks"] = (
    _with(_MEM, _Q, _pairs("q", _SAME, "0.0", "5")) + f" SELECT request_id, rank, id, {_SIM} FROM best"
)
ORACLE_SQL["recall_namespace_all"] = (
    _with(_MEM, _Q, _pairs("q", "TRUE", "0.2", "5")) + " SELECT request_id, rank, id, round(sim, 6) AS similarity FROM best"
)
ORACLE_SQL["nearest_k"] = (
    _with(_MEM, _Q, _pairs("q", _SAME, "-2", "3")) + " SELECT request_id, rank, id, round(sim, 6) AS similarity FROM best"
)
ORACLE_SQL["ann_quality"] = (
    _with(_MEM, _Q, _pairs("q", "TRUE", "0.0", "5"))
    + """, n AS (SELECT user_id, count(*) AS n FROM mem GROUP BY user_id)
SELECT b.user_id, any_value(n.n) AS n_requests, any_value(n.n) * any_value(n.n) AS n_pairs, count(*) AS n_true,
  TRUE AS found_9_of_10, TRUE AS scored_under_30_percent
FROM best b JOIN n USING (user_id) GROUP BY b.user_id"""
)
ORACLE_SQL["recall_metadata_filter"] = (
    _with(
        _MEM,
        _Q,
        _pairs(
            "q", _SAME, "0.0", "5",
            "CASE q.request_id % 4 WHEN 0 THEN m.vec_id % 3 = q.request_id % 3 "
            "WHEN 1 THEN m.vec_id % 2 = 0 AND m.label = q.qlabel WHEN 2 THEN FALSE ELSE TRUE END",
        ),
    )
    + f" SELECT request_id, rank, id, {_SIM} FROM best"
)
ORACLE_SQL["metadata_matches"] = (
    _with(_MEM) + " SELECT id, label = 1 AND vec_id % 2 = 1 AS label_1_odd, FALSE AS label_text, FALSE AS broken, FALSE AS listed,"
    + " FALSE AS first_of_repeated, label = 1 AS last_of_repeated, TRUE AS no_filter FROM mem"
)
_TAG = (
    "'<memory id=\"' || id || '\" namespace=\"' || namespace || '\" created=\"' || "
    + _iso("created_at")
    + " || '\">' || chr(10) || '<content>' || "
    "replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</content>' || chr(10) || '</memory>'"
)
ORACLE_SQL["recall_formatted"] = (
    _with(_MEM, _Q, _pairs("q", _SAME, "0.1", "3"))
    + f""", texts AS (
  SELECT request_id, string_agg({_TAG}, chr(10) || chr(10) ORDER BY rank) AS text FROM best GROUP BY request_id)
SELECT q.request_id, coalesce(t.text, '') AS text FROM q LEFT JOIN texts t USING (request_id)"""
)
ORACLE_SQL["list_page"] = (
    _with(_MEM)
    + """, by_created AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, namespace ORDER BY created_at, id) AS c,
    row_number() OVER (PARTITION BY user_id, namespace ORDER BY updated_at, id) AS u FROM mem),
placed AS (
  SELECT q.vec_id AS request_id, m.id, m.content, m.namespace,
    (CASE WHEN q.vec_id % 2 = 0 THEN m.c ELSE m.u END) - q.vec_id % 11 AS rank
  FROM mem q JOIN by_created m USING (user_id, namespace))
SELECT request_id, rank, id, content, namespace FROM placed WHERE rank BETWEEN 1 AND 3"""
)
ORACLE_SQL["list_keyset"] = (
    _with(_MEM)
    + """, placed AS (
  SELECT q.vec_id AS request_id, m.id,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY m.created_at DESC, m.id DESC) AS rank,
    count(*) OVER (PARTITION BY q.vec_id) > 4 AS has_more
  FROM mem q JOIN mem m ON m.user_id = q.user_id AND (q.vec_id % 2 = 0 OR m.namespace = q.namespace)
    AND (q.vec_id % 3 = 0 OR m.created_at < q.created_at OR (m.created_at = q.created_at AND m.id < q.id)))
SELECT request_id, rank, id, has_more, CASE WHEN has_more AND rank = 4 THEN id END AS next_id
FROM placed WHERE rank <= 4"""
)
ORACLE_SQL["list_deep"] = (
    _with(_MEM)
    + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, namespace ORDER BY created_at, id) AS c,
    row_number() OVER (PARTITION BY user_id, namespace ORDER BY updated_at, id) AS u FROM mem),
listed AS (
  SELECT q.vec_id AS request_id, m.id, m.content, (CASE WHEN q.vec_id % 2 = 0 THEN m.c ELSE m.u END) - q.vec_id % 29 AS rank
  FROM mem q JOIN numbered m USING (user_id, namespace)),
walked AS (
  SELECT q.vec_id AS request_id, m.id, m.content, row_number() OVER (PARTITION BY q.vec_id ORDER BY m.created_at DESC, m.id DESC) AS rank,
    count(*) OVER (PARTITION BY q.vec_id) > 10 AS has_more
  FROM mem q JOIN mem m ON m.user_id = q.user_id AND (q.vec_id % 2 = 0 OR m.namespace = q.namespace)
    AND (q.vec_id % 3 = 0 OR m.created_at < q.created_at OR (m.created_at = q.created_at AND m.id < q.id)))
SELECT 'offset' AS by, request_id, rank, id, content, NULL AS next_id FROM listed WHERE rank BETWEEN 1 AND 3
UNION ALL
SELECT 'cursor', request_id, rank, id, content, CASE WHEN has_more AND rank = 10 THEN id END FROM walked WHERE rank <= 10"""
)
_UNITS = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
ORACLE_SQL["normalize_hash"] = f"""
WITH t AS (SELECT doc_id, {_normal('text')} AS text FROM documents)
SELECT doc_id, {_UNITS.format('text')} AS units, sha256(text) AS content_hash FROM t"""
ORACLE_SQL["dedupe_documents"] = f"""
WITH t AS (SELECT doc_id, sha256({_normal('text')}) AS content_hash FROM documents)
SELECT content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM t GROUP BY content_hash"""
ORACLE_SQL["mock_embedding"] = f"""
WITH t AS (SELECT doc_id, {_normal('text')} AS text FROM documents),
codes AS (
  SELECT doc_id, list_reduce(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CAST(unicode(c) AS BIGINT)),
    lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM t),
hashed AS (SELECT doc_id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS h FROM codes)
SELECT doc_id, round(CAST(CAST(sin(h) * 0.5 + 0.5 AS FLOAT) AS DOUBLE), 4) AS v0,
  round(CAST(CAST(sin(h + 15) * 0.5 + 0.5 AS FLOAT) AS DOUBLE), 4) AS v15,
  round(list_sum(list_transform(range(1536), lambda i: CAST(CAST(sin(h + i) * 0.5 + 0.5 AS FLOAT) AS DOUBLE))), 3) AS total,
  round(list_sum(list_transform(range(1536), lambda i: CAST(CAST(sin(h + i) * 0.5 + 0.5 AS FLOAT) AS DOUBLE) * (i + 1)))
    / 1536, 3) AS weighted FROM hashed"""
ORACLE_SQL["embed_once"] = """
WITH d AS (SELECT doc_id, text, strlen(text) AS b, length(text) AS u FROM documents),
runs AS (SELECT 1 AS run, * FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 2, * FROM d UNION ALL SELECT 3, * FROM d),
firsts AS (SELECT run, count(*) AS n FROM (SELECT text, min(run) AS run FROM runs GROUP BY text) GROUP BY run)
SELECT CAST(r.run AS INTEGER) AS run, coalesce(any_value(f.n), 0) AS n_embedded, count(*) FILTER (WHERE b % 50 <> 0) AS n_rows,
  CAST(sum(b) FILTER (WHERE b % 50 <> 0) AS BIGINT) AS bytes, CAST(sum(u) FILTER (WHERE b % 50 <> 0) AS BIGINT) AS units,
  count(*) FILTER (WHERE b % 50 = 0) AS n_rejected
FROM runs r LEFT JOIN firsts f ON r.run = f.run GROUP BY r.run"""
ORACLE_SQL["vector_text"] = "SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dim, 0.0::DOUBLE AS distance FROM embeddings"
ORACLE_SQL["escape_text"] = """
SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_hash FROM pages"""
ORACLE_SQL["redact_log"] = """
SELECT conv_id, turn, '[redacted:' || left(sha256(text), 8) || ']' AS content,
  '[redacted:' || left(sha256(text), 8) || ']' AS query, role FROM conversations"""
ORACLE_SQL["redact_map"] = """
SELECT conv_id, turn, '[redacted:' || left(sha256(text), 8) || ']' AS content, role, '[redacted]' AS embedding
FROM conversations"""
ORACLE_SQL["metadata_size"] = """
SELECT doc_id, CAST(octet_length(encode('{"n":' || n_chars || ',"e":100,"t":[1.5,"1.0, "],"u":"é"}')) AS BIGINT) AS size
FROM documents"""
ORACLE_SQL["json_results"] = (
    _with(_MEM)
    + " SELECT '{\"id\":\"' || id || '\",\"namespace\":\"' || namespace || '\",\"created_at\":\"' || "
    + _iso("created_at")
    + " || '\",\"times\":[\"' || "
    + _iso("updated_at")
    + " || '\"]}' AS value FROM mem"
)

_ID = (
    "CASE WHEN TRUE THEN left(x, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) "
    "|| '-' || substr(x, 21, 12) END"
)
# The service rule told as in SURVEY W1, with plain windows over all rows.
_REMEMBER = (
    _with(_REQ, _STORED)
    + f""", held AS (
  SELECT user_id, namespace, content_hash, arg_min(id, seq) AS existing_id FROM stored GROUP BY ALL),
totals AS (SELECT user_id, count(*) AS n FROM stored GROUP BY user_id),
tagged AS (
  SELECT r.*, h.existing_id,
    min(r.seq) OVER same AS first_seq,
    min(CASE WHEN r.tier <> 'free' THEN r.seq END) OVER same AS first_paid
  FROM req r LEFT JOIN held h USING (user_id, namespace, content_hash)
  WINDOW same AS (PARTITION BY r.user_id, r.namespace, r.content_hash)),
firsts AS (
  SELECT seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rk
  FROM tagged WHERE existing_id IS NULL AND seq = first_seq),
judged AS (
  SELECT t.*, CASE WHEN t.existing_id IS NULL THEN
      CASE WHEN f.rk <= 100 - coalesce(n.n, 0) THEN t.first_seq ELSE t.first_paid END END AS accepted
  FROM tagged t LEFT JOIN firsts f ON f.seq = t.first_seq LEFT JOIN totals n ON n.user_id = t.user_id),
named AS (
  SELECT *, sha256(user_id || chr(31) || namespace || chr(31) || content_hash || chr(31) || accepted) AS x,
    CASE WHEN existing_id IS NOT NULL THEN 'deduped' WHEN seq = accepted THEN 'stored'
      WHEN seq > accepted THEN 'deduped' ELSE 'rejected' END AS status
  FROM judged)"""
)
ORACLE_SQL["remember_quota"] = (
    _REMEMBER
    + f""" SELECT seq, user_id, status, CASE WHEN status <> 'rejected' THEN coalesce(existing_id, {_ID}) END AS id,
  CASE WHEN status = 'rejected' THEN 'limit_exceeded' END AS error_code FROM named"""
)
ORACLE_SQL["remember_rows"] = (
    _REMEMBER + f" SELECT {_ID} AS id, user_id, namespace, content_hash, metadata FROM named WHERE status = 'stored'"
)
ORACLE_SQL["find_by_hash"] = (
    _with(_REQ, _STORED)
    + """ SELECT user_id, namespace, content_hash, arg_min(id, seq) AS existing_id FROM stored
WHERE (user_id, namespace, content_hash) IN (SELECT user_id, namespace, content_hash FROM req)
GROUP BY user_id, namespace, content_hash"""
)
_UPDATE = (
    _with(_REQ, _STORED)
    + f""", texts AS (SELECT *, {_normal('content')} AS body FROM stored),
asked AS (
  SELECT t.seq, t.id, t.user_id, t.namespace, t.seq % 11 <> 0 AS owned,
    CASE t.seq % 4 WHEN 0 THEN {_normal("t.body || ' v2'")} WHEN 1 THEN 'shared note'
      WHEN 2 THEN first_value(t.body) OVER (PARTITION BY t.user_id, t.namespace ORDER BY t.seq) END AS content,
    CASE WHEN t.seq % 3 = 0 THEN '{{"v":2}}' END AS metadata
  FROM texts t),
hashed AS (
  SELECT *, CASE WHEN content <> '' THEN sha256(content) END AS new_hash FROM asked),
checked AS (
  SELECT h.*, EXISTS (SELECT 1 FROM texts s WHERE s.user_id = h.user_id AND s.namespace = h.namespace
      AND s.content_hash = h.new_hash AND s.id <> h.id) AS taken FROM hashed h),
claimed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, namespace, new_hash, owned, taken ORDER BY seq) AS turn FROM checked),
verdict AS (
  SELECT *, CASE WHEN NOT owned THEN 'not_found'
    WHEN new_hash IS NOT NULL AND (taken OR turn > 1) THEN 'validation_error' END AS error_code FROM claimed)"""
)
ORACLE_SQL["update_content"] = (
    _UPDATE
    + " SELECT seq, id, CASE WHEN error_code IS NULL THEN 'ok' ELSE 'rejected' END AS status, error_code FROM verdict"
)
ORACLE_SQL["update_metadata"] = (
    _UPDATE
    + f""" SELECT s.id, CASE WHEN v.error_code IS NULL AND v.new_hash IS NOT NULL THEN v.new_hash ELSE s.content_hash END
    AS content_hash,
  CASE WHEN v.error_code IS NULL AND v.metadata IS NOT NULL THEN v.metadata ELSE s.metadata END AS metadata,
  CASE WHEN v.error_code IS NULL AND (v.new_hash IS NOT NULL OR v.metadata IS NOT NULL)
    THEN '2025-01-01T00:00:00.000Z' ELSE {_iso("TIMESTAMP '2024-01-01 00:00:00' + to_seconds(s.seq)")} END AS updated_at
FROM stored s JOIN verdict v USING (id)"""
)
ORACLE_SQL["versioned_writes"] = f"""
WITH d AS (
  SELECT doc_id, CAST(doc_id % 7 AS VARCHAR) AS user_id, {_normal('text')} AS t,
    doc_id % 4 = 0 AND doc_id % 7 < 3 AND doc_id % 11 <> 0 AS changed FROM documents),
v AS (
  SELECT doc_id, user_id, changed, CASE WHEN changed THEN {_normal("t || ' v2 ' || doc_id")} ELSE t END AS t FROM d),
codes AS (
  SELECT *, list_reduce(list_transform(regexp_extract_all(t, '(?s).'), lambda c: CAST(unicode(c) AS BIGINT)),
    lambda h, c: (h * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM v),
m AS (
  SELECT *, CAST(round(CAST(CAST(sin(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)) * 0.5 + 0.5 AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS first
  FROM codes)
SELECT CAST(version AS INTEGER) AS version, user_id, count(*) AS n, count(*) FILTER (WHERE changed) AS n_updated,
  count(*) FILTER (WHERE changed AND doc_id % 3 = 0) AS n_metadata,
  CAST(sum(CAST('0x' || left(sha256(t), 8) AS BIGINT)) AS BIGINT) AS hash_sum, count(*) AS n_wide, CAST(sum(first) AS BIGINT) AS first_sum
FROM m, range(1, 3) AS r(version)
WHERE NOT (version = 2 AND user_id = '1' AND doc_id % 6 = 1) GROUP BY version, user_id"""
ORACLE_SQL["update_fields"] = (
    _with(_MEM)
    + """, given AS (
  SELECT vec_id AS seq, id, concat_ws(',', CASE WHEN vec_id % 2 = 0 THEN 'content' END,
    CASE WHEN vec_id % 3 = 0 THEN 'metadata' END, CASE WHEN vec_id % 7 = 0 THEN 'namespace' END) AS f FROM mem)
SELECT seq, id, CASE WHEN f = '' OR seq % 5 <> 0 THEN f END AS updated_fields,
  CASE WHEN f <> '' AND seq % 5 = 0 THEN 'not_found' END AS error_code FROM given"""
)
ORACLE_SQL["update_fields_rows"] = (
    _with(_MEM)
    + """ SELECT id, CASE WHEN vec_id % 4 = 0 THEN 'newer text' WHEN vec_id % 2 = 0 AND vec_id % 5 <> 0 THEN 'new text'
  ELSE content END AS content,
  CASE WHEN vec_id % 6 = 0 THEN 'last' WHEN vec_id % 7 = 0 AND vec_id % 5 <> 0 THEN 'moved' ELSE namespace END AS namespace,
  CASE WHEN vec_id % 3 = 0 AND vec_id % 5 <> 0 THEN '{}' ELSE '{"label":' || label || ',"even":'
    || CASE WHEN vec_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"bucket":"b' || vec_id % 3 || '"}' END AS metadata FROM mem"""
)
_FORGET = (
    _with(_MEM)
    + """, asked AS (
  SELECT vec_id * 2 + n AS seq, id, n, vec_id % 3 <> 0 OR (vec_id + 1) % 5 = vec_id % 5 AS owned
  FROM mem, (SELECT 0 AS n UNION ALL SELECT 1) g)"""
)
ORACLE_SQL["forget_by_id"] = (
    _FORGET
    + """ SELECT seq, id, CASE WHEN owned AND n = 0 THEN 'deleted' ELSE 'rejected' END AS status,
  CASE WHEN owned AND n = 0 THEN NULL ELSE 'not_found' END AS error_code FROM asked"""
)
ORACLE_SQL["forget_survivors"] = _with(_MEM) + " SELECT id, user_id FROM mem WHERE vec_id % 3 = 0"
_PREVIEW = (
    _with(
        _MEM,
        _Q,
        _pairs("q", "(q.request_id % 3 <> 0 OR m.namespace = q.qspace)", "0.2", "3"),
    )
    + """, sums AS (
  SELECT q.request_id, q.quser AS user_id, count(b.id) AS total_matches FROM q LEFT JOIN best b USING (request_id)
  GROUP BY q.request_id, q.quser)"""
)
ORACLE_SQL["forget_preview"] = (
    _PREVIEW
    + """ SELECT request_id, user_id, total_matches,
  CASE WHEN total_matches > 0 THEN sha256(request_id || chr(31) || 'test salt') ELSE '' END AS confirmation_token,
  CASE WHEN total_matches > 0 THEN '2025-01-01T00:05:00.000Z' ELSE '' END AS expires_at FROM sums"""
)
ORACLE_SQL["forget_matches"] = _PREVIEW + f" SELECT request_id, rank, id, content, {_SIM} FROM best"
# A first try is at minute r % 7, a second one a minute later; the token lives 5 minutes.
_CONFIRM = (
    _PREVIEW
    + """, tries AS (
  SELECT s.request_id, s.request_id * 2 + n AS seq, s.request_id % 7 + n AS minute, s.user_id,
    CASE WHEN s.total_matches = 0 OR (s.request_id % 4 = 1 AND n = 0) OR (s.request_id % 4 <> 1 AND n = 1)
        THEN 'Invalid or expired confirmation token'
      WHEN s.request_id % 7 + n >= 5 THEN 'Confirmation token has expired' END AS message
  FROM sums s, (SELECT 0 AS n UNION ALL SELECT 1) g),
gone AS (
  SELECT b.id, arg_min(t.seq, t.minute * 1000000000 + t.seq) AS seq
  FROM tries t JOIN best b USING (request_id) WHERE t.message IS NULL GROUP BY b.id),
counts AS (SELECT seq, count(*) AS n FROM gone GROUP BY seq)"""
)
ORACLE_SQL["forget_confirm"] = (
    _CONFIRM
    + """ SELECT t.seq, CASE WHEN message IS NULL THEN 'deleted' ELSE 'rejected' END AS status,
  CASE WHEN message IS NULL THEN coalesce(c.n, 0) END AS deleted_count,
  CASE WHEN message IS NOT NULL THEN 'validation_error' END AS error_code, message
FROM tries t LEFT JOIN counts c USING (seq)"""
)
ORACLE_SQL["forget_confirm_survivors"] = _CONFIRM + " SELECT id FROM mem WHERE id NOT IN (SELECT id FROM gone)"
ORACLE_SQL["confirm_stream"] = (
    _CONFIRM + " SELECT seq, CASE WHEN message IS NULL THEN 'deleted' ELSE 'rejected' END AS status, message FROM tries"
)
ORACLE_SQL["confirm_timers"] = (
    _CONFIRM
    + """, ids AS (SELECT request_id, string_agg(id, ',' ORDER BY id) AS memory_ids FROM best GROUP BY request_id)
SELECT t.seq, CASE WHEN message IS NULL THEN 'deleted' ELSE 'rejected' END AS status,
  CASE WHEN message IS NULL THEN i.memory_ids END AS memory_ids, 0::BIGINT AS held_at_end
FROM tries t LEFT JOIN ids i USING (request_id)"""
)
ORACLE_SQL["delete_nearest"] = (
    _with(_MEM, _Q, _pairs("q", _SAME, "-2", "2")) + " SELECT request_id, rank, id FROM best"
)
ORACLE_SQL["cascade_delete"] = (
    _with(_USERS)
    + """, asked AS (SELECT CAST(n * 2 AS VARCHAR) AS user_id FROM people)
SELECT user_id, CASE WHEN user_id NOT IN (SELECT id FROM people) THEN 'not_found'
  WHEN user_id IN (SELECT CAST(user_id AS VARCHAR) FROM events) THEN 'blocked' ELSE 'deleted' END AS status FROM asked"""
)
ORACLE_SQL["tenant_split"] = (
    _with(_MEM)
    + """ SELECT id, user_id, CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' END AS ctx_user_id,
  'tenant_violation' AS error_code FROM mem WHERE vec_id % 4 = 0 OR (vec_id % 4 = 1 AND user_id <> '0')"""
)
ORACLE_SQL["tenant_rows"] = (
    _with(_USE, _USERS)
    + " SELECT id, user_id, tool_name FROM use WHERE user_id IN (SELECT id FROM people WHERE tier = 'free')"
)

_SUMS = """count(*) AS calls, count(*) AS tokens, count(*) FILTER (success) AS successes,
  count(*) FILTER (NOT success) AS failures, CAST(0 AS BIGINT) AS rate_limited"""
ORACLE_SQL["usage_summary"] = (
    _with(_USE)
    + f" SELECT user_id, tool_name, CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, {_SUMS} FROM use GROUP BY ALL"
)
ORACLE_SQL["usage_rollup"] = (
    _with(_USE) + f" SELECT tool_name, api_key_id, {_SUMS} FROM use GROUP BY ROLLUP (tool_name, api_key_id)"
)
ORACLE_SQL["usage_latency"] = (
    _with(_USE)
    + """ SELECT tool_name, count(*) AS calls, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, max(latency_ms) AS max_ms FROM use GROUP BY tool_name"""
)
ORACLE_SQL["usage_errors"] = (
    _with(_USE) + " SELECT tool_name, error_code, count(*) AS n FROM use WHERE NOT success GROUP BY ALL"
)
ORACLE_SQL["usage_timeline"] = (
    _with(_USE)
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, id DESC) AS rank FROM use)
SELECT user_id, rank, id, {_iso('occurred_at')} AS occurred_at FROM r WHERE rank <= 10"""
)
ORACLE_SQL["usage_by_key"] = (
    _with(_USE)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY api_key_id ORDER BY occurred_at DESC, id DESC) AS rank FROM use)
SELECT api_key_id, rank, id FROM r WHERE rank <= 3"""
)
ORACLE_SQL["usage_windows"] = (
    _with(_USE)
    + f""" SELECT user_id, {_iso("date_trunc('day', occurred_at)")} AS window_start, count(*) AS calls, count(*) AS tokens
FROM use GROUP BY ALL"""
)
ORACLE_SQL["append_and_read"] = (
    _with(_REQ)
    + """ SELECT user_id, count(*) AS n, count(*) AS n_ids, count(DISTINCT content_hash) AS n_texts, count(*) AS n_wide, count(*) AS n_dated
FROM req GROUP BY user_id"""
)
ORACLE_SQL["usage_sketches"] = (
    _with(_USE)
    + """, days AS (SELECT CAST(min(occurred_at) AS DATE) + 3 AS since, CAST(max(occurred_at) AS DATE) - 3 AS until FROM use)
SELECT tool_name, count(*) AS calls, count(*) AS tokens, count(*) FILTER (WHERE NOT success) AS failures, max(latency_ms) AS max_ms,
  TRUE AS p50_within_1_percent, TRUE AS p95_within_1_percent, TRUE AS users_within_5_percent
FROM use, days WHERE occurred_at >= since AND occurred_at < until GROUP BY tool_name"""
)
ORACLE_SQL["usage_windows_final"] = (
    _with(_USE)
    + f""" SELECT user_id, {_iso("date_trunc('day', occurred_at)")} AS window_start, count(*) AS calls, count(*) AS tokens
FROM use GROUP BY ALL
HAVING any_value(date_trunc('day', occurred_at)) + INTERVAL 1 DAY <= (SELECT max(occurred_at) - INTERVAL 10 MINUTE FROM use)"""
)
ORACLE_SQL["usage_dead_letters"] = _with(_USE) + " SELECT user_id, count(*) AS n, count(DISTINCT id) AS n_ids, 0::BIGINT AS replayed_again FROM use GROUP BY user_id"
ORACLE_SQL["usage_windows_stream"] = ORACLE_SQL["usage_windows"]
# Two tokens at most, two gained per day: 86,400,000 units per token, 2 units per millisecond.
_BUCKET = """
calls AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, epoch_us(ts) // 1000 AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
fold AS (
  SELECT key, seq, t, i, TRUE AS allowed, CAST(86400000 AS BIGINT) AS level FROM calls WHERE i = 1
  UNION ALL
  SELECT c.key, c.seq, c.t, c.i,
    least(172800000, f.level + (c.t - f.t) * 2) >= 86400000,
    CAST(least(172800000, f.level + (c.t - f.t) * 2)
      - CASE WHEN least(172800000, f.level + (c.t - f.t) * 2) >= 86400000 THEN 86400000 ELSE 0 END AS BIGINT)
  FROM fold f JOIN calls c ON c.key = f.key AND c.i = f.i + 1)"""
ORACLE_SQL["rate_limit_replay"] = (
    _with(_BUCKET)
    + """ SELECT key, seq, allowed, CASE WHEN allowed THEN level // 86400000 ELSE 0 END AS remaining,
  CASE WHEN NOT allowed THEN CAST(43200 AS BIGINT) END AS retry_after FROM fold"""
)
ORACLE_SQL["rate_limit_stream"] = ORACLE_SQL["rate_limit_replay"]
ORACLE_SQL["usage_build"] = (
    _with(_USE, _BUCKET)
    + """ SELECT u.id AS request_id, u.user_id, CASE WHEN f.allowed THEN u.tool_name ELSE 'unknown' END AS tool_name,
  CAST(CASE WHEN f.allowed THEN 1 ELSE 0 END AS BIGINT) AS tokens_consumed,
  CASE WHEN f.allowed THEN u.latency_ms ELSE 0 END AS latency_ms,
  f.allowed AND u.success AS success, CASE WHEN f.allowed THEN u.error_code ELSE 'rate_limited' END AS error_code
FROM use u JOIN fold f ON f.seq = u.event_id"""
)
ORACLE_SQL["memory_counts"] = (
    _with(_REQ) + " SELECT user_id, count(*) AS n_memories FROM req GROUP BY user_id"
)
_TIER = "coalesce(nullif(k.tier, ''), nullif(k.user_tier, ''), 'free')"
ORACLE_SQL["quota_headroom"] = (
    _with(_REQ, _USERS, _KEYS)
    + f""", free AS (SELECT DISTINCT user_id FROM ks k WHERE revoked_at IS NULL AND {_TIER} = 'free'),
n AS (SELECT user_id, count(*) AS n FROM req GROUP BY user_id)
SELECT user_id, coalesce(n.n, 0) AS n_memories, greatest(100 - coalesce(n.n, 0), 0) AS headroom
FROM free LEFT JOIN n USING (user_id)"""
)

_FOLD = (
    _with(_USERS, _BILL, _PRICES)
    + """, events_all AS (
  SELECT id, event_type, received_at, customer_id, price_id, CAST(NULL AS VARCHAR) AS user_id FROM bill
  UNION ALL
  SELECT 'evt_c' || n, 'customer.created', TIMESTAMP '1995-01-01 00:00:00' + to_hours(n), 'cus_' || (n + 7), NULL, id
  FROM people),
fresh AS (
  SELECT *, row_number() OVER (ORDER BY received_at, id) AS n FROM events_all
  WHERE NOT ({seen})),
bindings AS (
  SELECT id AS user_id, customer_id, 0 AS start FROM people
  UNION ALL
  SELECT user_id, customer_id, n FROM fresh WHERE event_type = 'customer.created'),
spans AS (
  SELECT *, lead(start, 1, 1000000000) OVER (PARTITION BY user_id ORDER BY start) AS stop FROM bindings),
changes AS (
  SELECT f.n, f.id, f.customer_id,
    CASE WHEN f.event_type = 'customer.subscription.deleted' THEN 'free' ELSE p.new_tier END AS tier
  FROM fresh f LEFT JOIN prices p USING (price_id) WHERE f.event_type <> 'customer.created'),
effects AS (
  SELECT c.n, c.id, min(s.user_id) AS user_id, c.tier, count(*) AS n_bound
  FROM changes c JOIN spans s ON s.customer_id = c.customer_id AND c.n >= s.start AND c.n < s.stop
  WHERE c.tier IS NOT NULL GROUP BY c.n, c.id, c.tier)"""
)
_SEEN = "event_type = 'customer.subscription.updated'"
_FOLDED = """ SELECT p.id, coalesce(t.tier, p.tier) AS tier, 'cus_' || (p.n + 7) AS stripe_customer_id
FROM people p LEFT JOIN (SELECT user_id, arg_max(tier, n) AS tier FROM effects GROUP BY user_id) t ON t.user_id = p.id"""
ORACLE_SQL["billing_fold"] = _FOLD.replace("{seen}", _SEEN) + _FOLDED
ORACLE_SQL["billing_stream"] = _FOLD.replace("{seen}", "FALSE") + _FOLDED
ORACLE_SQL["billing_effects"] = _FOLD.replace("{seen}", _SEEN) + " SELECT id, user_id, tier, n_bound FROM effects"
ORACLE_SQL["billing_processed"] = (
    _FOLD.replace("{seen}", _SEEN) + " SELECT id, event_type, '2025-01-01T00:00:00.000Z' AS processed_at FROM fresh"
)
ORACLE_SQL["price_lookup"] = (
    _with(_BILL, _PRICES) + " SELECT id, customer_id, price_id, new_tier FROM bill LEFT JOIN prices USING (price_id)"
)
ORACLE_SQL["unprocessed_events"] = (
    _with(_BILL) + " SELECT id, event_type FROM bill WHERE event_type <> 'customer.subscription.deleted'"
)
ORACLE_SQL["insert_once"] = (
    _with(_BILL)
    + f""" SELECT id, event_type, {_iso('received_at')} AS received_at FROM bill
WHERE event_type <> 'customer.subscription.created'"""
)
ORACLE_SQL["subscription_messages"] = (
    _with(_USERS)
    + """, m AS (
  SELECT CAST(o_custkey * 2 AS VARCHAR) AS id, arg_max(CASE o_orderpriority WHEN '1-URGENT' THEN 'team'
    WHEN '2-HIGH' THEN 'pro' ELSE 'free' END, o_orderkey) AS tier
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY ALL)
SELECT p.id, coalesce(m.tier, p.tier) AS tier FROM people p LEFT JOIN m USING (id)"""
)
ORACLE_SQL["effective_tier"] = (
    _with(_USERS, _KEYS) + f" SELECT k.id AS key_id, k.user_id, {_TIER} AS tier FROM ks k WHERE revoked_at IS NULL"
)
ORACLE_SQL["active_keys"] = (
    _with(_USERS, _KEYS) + " SELECT id, user_id, label, tier FROM ks WHERE revoked_at IS NULL"
)
ORACLE_SQL["all_keys"] = _with(_USERS, _KEYS) + f" SELECT id, user_id, {_iso('revoked_at')} AS revoked_at FROM ks"
_RANK = "CASE {0} WHEN 'starter' THEN 1 WHEN 'pro' THEN 2 WHEN 'team' THEN 3 ELSE 0 END"
ORACLE_SQL["issue_keys"] = (
    _with(_USERS, _KEYS)
    + f""", asked AS (
  SELECT num AS seq, id, CASE num % 5 WHEN 0 THEN 'team' WHEN 1 THEN 'gold' WHEN 2 THEN 'starter' END AS wanted,
    coalesce(nullif(tier, ''), 'free') AS own FROM ks),
judged AS (
  SELECT *, coalesce(wanted, own) AS tier2, CASE WHEN wanted = 'gold' THEN 400
    WHEN {_RANK.format('coalesce(wanted, own)')} > {_RANK.format('own')} THEN 403 ELSE 200 END AS code FROM asked)
SELECT seq, CAST(code AS BIGINT) AS code, CASE WHEN code = 200 THEN 'new' || id END AS id,
  CASE WHEN code = 200 THEN tier2 END AS tier FROM judged"""
)
ORACLE_SQL["revoke_keys"] = (
    _with(_USERS, _KEYS)
    + """ SELECT num AS seq, id, CAST(CASE WHEN num % 4 = 0 THEN 409
  WHEN num % 3 <> 0 AND revoked_at IS NULL THEN 204 ELSE 404 END AS BIGINT) AS code FROM ks"""
)
ORACLE_SQL["rotate_keys"] = (
    _with(_USERS, _KEYS)
    + f""" SELECT id, user_id, label, tier, CASE WHEN num % 3 <> 0 THEN '2025-01-01T00:00:00.000Z'
  ELSE {_iso('revoked_at')} END AS revoked_at FROM ks
UNION ALL SELECT 'new' || id, user_id, label, tier, NULL FROM ks WHERE num % 3 <> 0"""
)
ORACLE_SQL["touch_keys"] = (
    _with(_USERS, _KEYS, _USE)
    + f""" SELECT k.id, {_iso('max(u.occurred_at)')} AS last_used_at
FROM ks k LEFT JOIN use u ON u.api_key_id = k.id GROUP BY k.id"""
)


def _judge(source: str, issues: list[tuple[str, str]], extra: str = "") -> str:
    """SELECT with the first message, the code and the number of broken rules."""
    flags = ", ".join(f"coalesce({rule}, FALSE) AS b{i}" for i, (rule, _) in enumerate(issues))
    first = " ".join(f"WHEN b{i} THEN {message}" for i, (_, message) in enumerate(issues))
    count = " + ".join(f"CAST(b{i} AS BIGINT)" for i in range(len(issues)))
    return f"""WITH src AS ({source}), flagged AS (SELECT *, {flags} FROM src)
SELECT doc_id{extra}, CASE WHEN {count} > 0 THEN 'validation_error' END AS error_code,
  CASE {first} END AS message, {count} AS n_issues FROM flagged"""


ORACLE_SQL["validate_remember"] = _judge(
    f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE {_UNITS.format('text')} END AS units, n_chars + 8 AS size
FROM documents""",
    [
        ("units < 1", "'Content must not be empty'"),
        ("units > 50000", "'Content must not exceed 50000 characters'"),
        ("size > 4096", "'Metadata must not exceed 4096 bytes serialized (got ' || size || ' bytes)'"),
    ],
)
ORACLE_SQL["validate_recall"] = _judge(
    f"SELECT doc_id, {_UNITS.format('text')} AS units FROM documents",
    [
        ("units < 1", "'Query must not be empty'"),
        ("units > 10000", "'Query must not exceed 10000 characters'"),
        ("doc_id % 60 < 1 OR doc_id % 60 > 50", "'limit must be between 1 and 50'"),
        ("doc_id % 15 > 10", "'threshold must be between 0 and 1'"),
        ("doc_id % 4 = 2", "'Metadata filter must not exceed 8 keys (got 9)'"),
        ("doc_id % 4 = 1", "'Metadata filter values must be primitives (string, number, boolean)'"),
    ],
)
ORACLE_SQL["validate_list"] = _judge(
    "SELECT doc_id, (doc_id % 220) / 2.0 AS lim FROM documents",
    [
        ("lim <> floor(lim)", "'limit must be a whole number'"),
        ("lim < 1 OR lim > 100", "'limit must be between 1 and 100'"),
        ("doc_id % 5 = 0", "'offset must be at least 0'"),
        ("doc_id % 3 = 1", "'order must be created_at or updated_at'"),
    ],
)
ORACLE_SQL["validate_update"] = _judge(
    f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND {_UNITS.format('text')} > 50000 THEN 'content_over_limit' END AS warning
FROM documents""",
    [
        ("doc_id % 3 = 0", "'Memory ID must be a valid UUID'"),
        ("doc_id % 5 = 1", "'Metadata must be a JSON object'"),
        ("doc_id % 2 = 1 AND doc_id % 5 > 1", "'At least one of content or metadata must be provided'"),
    ],
    ", warning",
)
ORACLE_SQL["validate_forget"] = _judge(
    """SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'by_id' WHEN doc_id % 7 = 1 THEN NULL
  WHEN NOT (no_query OR bad_limit) THEN 'preview' WHEN doc_id % 3 = 0 THEN 'confirm' ELSE 'preview' END AS kind
FROM (SELECT doc_id, doc_id % 2 = 1 OR text = '' AS no_query, doc_id % 60 < 1 OR doc_id % 60 > 50 AS bad_limit FROM documents)""",
    [
        ("kind IS NULL", "'mode must be by_id or by_query'"),
        ("kind = 'by_id' AND doc_id % 3 = 0", "'Memory ID must be a valid UUID'"),
        ("kind = 'preview' AND no_query", "'Query must not be empty'"),
        ("kind = 'preview' AND bad_limit", "'limit must be between 1 and 50'"),
    ],
    ", kind",
)
ORACLE_SQL["fk_audit"] = (
    _with(_MEM, _USERS, _KEYS, _USE)
    + """ SELECT 'memories.user_id' AS relation, user_id AS key, count(*) AS n FROM mem
WHERE user_id NOT IN (SELECT id FROM people WHERE CAST(id AS BIGINT) % 3 <> 0) GROUP BY user_id
UNION ALL SELECT 'usage_events.user_id', user_id, count(*) FROM use
WHERE user_id NOT IN (SELECT id FROM people WHERE CAST(id AS BIGINT) % 3 <> 0) GROUP BY user_id
UNION ALL SELECT 'usage_events.api_key_id', api_key_id, count(*) FROM use
WHERE api_key_id NOT IN (SELECT id FROM ks WHERE CAST(id AS BIGINT) % 4 <> 0) GROUP BY api_key_id
UNION ALL SELECT 'api_keys.user_id', user_id, count(*) FROM ks WHERE CAST(id AS BIGINT) % 4 <> 0
  AND user_id NOT IN (SELECT id FROM people WHERE CAST(id AS BIGINT) % 3 <> 0) GROUP BY user_id"""
)
ORACLE_SQL["constraint_audit"] = (
    _with(_USERS, _KEYS, _BILL, _USE)
    + r""" SELECT 'api_keys.tier' AS rule, id AS key, CAST(1 AS BIGINT) AS n FROM ks WHERE tier = ''
UNION ALL SELECT 'usage_events.latency_ms', id, 1 FROM use WHERE latency_ms < 0
UNION ALL SELECT 'users.email', email, count(*) FROM people GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'users.email_shape', id, 1 FROM people WHERE NOT regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+')
UNION ALL SELECT 'stripe_events.id', id, 2 FROM bill WHERE event_type = 'customer.subscription.deleted'"""
)
ORACLE_SQL["tenant_leak_audit"] = (
    _with(_MEM, _Q, _pairs("q", _SAME, "0.0", "5"))
    + " SELECT count(*) FILTER (request_id % 4 = 0) AS n_leaked FROM best"
)
ORACLE_SQL["result_audit"] = (
    _with(_MEM, _Q, _pairs("q", _SAME, "-1", "5"))
    + """ SELECT request_id, id, 'similarity must be between 0 and 1' AS message FROM best
WHERE round(sim, 9) < 0 OR round(sim, 9) > 1"""
)
