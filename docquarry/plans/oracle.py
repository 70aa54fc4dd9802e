"""The queries of ``registry`` in SQL over the given tables, written apart from the Spark code."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-20 00:00:00'"

EMAIL = "lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example'"

ACCOUNTS = f"""accounts AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, {EMAIL} AS email, c_acctbal > 0 AS "emailVerified",
         TIMESTAMP '2023-01-01' + to_minutes(c_custkey) AS "createdAt" FROM customer)"""

DOCS = """docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Order ' || o_orderkey AS "fileName",
         CAST(floor(o_totalprice) AS BIGINT) AS "fileSize",
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'application/pdf'
              WHEN o_orderpriority = '3-MEDIUM'
              THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
              ELSE 'text/plain' END AS "mimeType",
         'documents/' || o_custkey || '/' || o_orderkey AS "r2Key",
         CASE WHEN o_orderstatus IN ('F', 'P') THEN 'up-' || o_orderkey END AS "uploadId",
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'PROCESSING' ELSE 'PENDING_UPLOAD' END AS status,
         CAST(o_custkey AS VARCHAR) AS "userId", CAST(o_orderdate AS TIMESTAMP) AS "createdAt" FROM orders)"""

LOG = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, ts AS "updatedAt",
         CASE event_type WHEN 'signup' THEN 'PENDING_UPLOAD' WHEN 'view' THEN 'UPLOAD_COMPLETED'
              WHEN 'click' THEN 'QUEUED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
         'documents/' || user_id || '/' || user_id AS "r2Key",
         CASE WHEN value >= 10 THEN 'up-' || event_id END AS "uploadId",
         CASE WHEN event_type = 'error' AND value < 25 THEN 'code ' || (props->>'$.k') END AS "errorMessage"
  FROM events),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY "updatedAt" DESC, seq DESC) = 1)"""

SESSIONS = """sessions AS (
  SELECT 's' || event_id AS id, CAST(event_id AS VARCHAR) AS token, CAST(user_id AS VARCHAR) AS "userId",
         ts + INTERVAL 7 DAY AS "expiresAt", ts AS "createdAt" FROM events WHERE event_type = 'signup')"""

REFRESH = f"""{SESSIONS},
asked AS (
  SELECT CAST(event_id AS VARCHAR) AS "requestId", CASE WHEN value >= 2 THEN CAST(event_id - 1 - event_id % 3 AS VARCHAR) END AS token,
         'new-' || event_id AS "newToken", ts AS "requestedAt" FROM events WHERE event_type = 'click'),
outcomes AS (
  SELECT a."requestId", a.token, a."newToken", a."requestedAt", s.id AS "sessionId", s."userId",
         CASE WHEN a.token IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'unknown'
              WHEN s."expiresAt" < {NOW} THEN 'expired' ELSE 'valid' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY "requestedAt", "requestId") AS turn FROM asked) a
  LEFT JOIN sessions s ON s.token = a.token AND a.turn = 1)"""

SIGNUPS = f"""{ACCOUNTS},
signups AS (
  SELECT event_id AS "requestId", c_name AS name,
         CASE WHEN value < 20 THEN {EMAIL} WHEN value < 90 THEN 'new.' || user_id || '@example.com'
              ELSE 'new.' || user_id || '@example.com@' END AS email,
         't' || event_id AS token, ts AS "requestedAt", value
  FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'signup'),
granted AS (
  SELECT * FROM signups WHERE value >= 20 AND value < 90
  QUALIFY row_number() OVER (PARTITION BY email ORDER BY "requestedAt", "requestId") = 1)"""

LOGINS = f"""attempts AS (
  SELECT event_id AS "attemptId", CASE WHEN value < 5 THEN '' WHEN value < 40 THEN {EMAIL}
         WHEN value < 80 THEN 'nobody@example.com' END AS email, CAST(user_id AS VARCHAR) AS "userId",
         value >= 5 AND value < 40 AS known, 't' || event_id AS token, ts AS "attemptedAt"
  FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click')"""

UPLOADS = """uploads AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS "requestId", CAST(o_custkey AS VARCHAR) AS "userId", o_custkey, o_orderkey,
         repeat(o_orderpriority, CAST(trunc(o_totalprice / 10000) AS BIGINT)) AS "fileName",
         (CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE 1 END)
           * (CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE floor(o_totalprice) END) AS "fileSize",
         CASE o_orderpriority WHEN '1-URGENT' THEN 'application/pdf'
              WHEN '2-HIGH' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
              WHEN '3-MEDIUM' THEN 'text/csv' ELSE 'text/plain' END AS "mimeType" FROM orders),
errors AS (
  SELECT "requestId", 'fileName' AS field, CASE WHEN "fileName" = '' THEN 'too_small' ELSE 'too_big' END AS code
  FROM uploads WHERE "fileName" = '' OR length("fileName") > 255
  UNION ALL
  SELECT "requestId", 'fileSize', CASE WHEN "fileSize" <> floor("fileSize") THEN 'invalid_type'
         WHEN "fileSize" <= 0 THEN 'too_small' ELSE 'too_big' END
  FROM uploads WHERE "fileSize" <> floor("fileSize") OR "fileSize" <= 0 OR "fileSize" > {max_bytes}
  UNION ALL
  SELECT "requestId", 'mimeType', 'invalid_value' FROM uploads WHERE "mimeType" = 'text/csv')"""

CHECKED = UPLOADS.format(max_bytes=300000)

INTAKE = f"""{UPLOADS.format(max_bytes=104857600)},
fresh AS (
  SELECT sha256("userId" || chr(31) || "requestId") AS id, "userId", CAST("fileSize" AS BIGINT) AS "fileSize",
         "fileName", "mimeType"
  FROM uploads WHERE "requestId" NOT IN (SELECT "requestId" FROM errors)
  AND "requestId" IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'))"""

MANIFEST = """manifest AS (
  SELECT lang, source, doc_id, n_chars,
         '{"fileName":' || CASE lang WHEN 'es' THEN CAST(doc_id AS VARCHAR) WHEN 'en' THEN '0' ELSE '"doc-' || doc_id || '.txt"' END
         || ',"fileSize":' || CASE lang WHEN 'fr' THEN '"' || n_chars || '"' WHEN 'de' THEN n_chars || '.5'
                                   ELSE CAST(n_chars AS VARCHAR) END
         || CASE WHEN lang = 'en' THEN ',"fileName":"doc-' || doc_id || '.txt"' ELSE '' END || ',"mimeType":"text/plain"' || CASE WHEN source = 'src0' THEN '' ELSE '}' END AS line FROM documents)"""

CHUNKS = """chunks AS (
  SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_no, CAST(i * 700 AS INTEGER) AS start,
         substring(text, i * 700 + 1, 800) AS passage
  FROM (SELECT doc_id, source, text,
               unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 700.0) AS BIGINT), 1))) AS i
        FROM documents WHERE text <> ''))"""

TERM_BREAK = r"[^\p{L}\p{N}]+"


def _buckets(text: str, dims: int) -> str:
    terms = f"list_filter(regexp_split_to_array(lower({text}), '{TERM_BREAK}'), lambda t: t <> '')"
    return f"list_transform({terms}, lambda t: CAST('0x' || md5(t)[1:8] AS BIGINT) % {dims})"


def _vectors(name: str, source: str, key: str, text: str) -> str:
    """Sparse hashed TF-IDF of the rows of ``source`` as ``name(key, bucket, w)``, weights as stored floats."""
    return f"""{name}_tf AS (
  SELECT {key}, bucket, count(*) AS tf FROM (SELECT {key}, unnest({_buckets(text, 256)}) AS bucket FROM {source})
  GROUP BY ALL),
{name}_raw AS (SELECT {key}, bucket, tf * idf AS w FROM {name}_tf JOIN weights USING (bucket)),
{name} AS (
  SELECT {key}, bucket, CAST(CAST(w / norm AS FLOAT) AS DOUBLE) AS w FROM {name}_raw
  JOIN (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name}_raw GROUP BY ALL) USING ({key})
  WHERE norm > 0)"""


def _dense(name: str, source: str, key: str) -> str:
    """The vectors of ``source`` as lists ``v``."""
    return f"""{name} AS (
  SELECT {key}, list(coalesce(w, 0) ORDER BY bucket) AS v
  FROM (SELECT DISTINCT {key} FROM {source}) CROSS JOIN (SELECT unnest(range(0, 256)) AS bucket)
  LEFT JOIN {source} USING ({key}, bucket) GROUP BY ALL)"""


WEIGHTS = f"""weights AS (
  SELECT bucket, ln(((SELECT count(*) FROM chunks) + 1) / (coalesce(n, 0) + 1)) AS idf
  FROM (SELECT unnest(range(0, 256)) AS bucket)
  LEFT JOIN (SELECT bucket, count(*) AS n
             FROM (SELECT unnest(list_distinct({_buckets("passage", 256)})) AS bucket FROM chunks)
             GROUP BY bucket) USING (bucket))"""


def _retrieval(questions: str, k: int) -> str:
    """``hits(question_id, rank, doc_id, chunk_no, score)`` of all questions over all chunks."""
    return f"""{CHUNKS},
{WEIGHTS},
{_vectors("cv", "chunks", "doc_id, chunk_no", "passage")},
questions AS ({questions}),
{_vectors("qv", "questions", "question_id", "text")},
{_dense("cd", "cv", "doc_id, chunk_no")},
{_dense("qd", "qv", "question_id")},
scores AS (
  SELECT question_id, doc_id, chunk_no,
         round(list_inner_product(q.v, c.v)
               / sqrt(list_inner_product(q.v, q.v) * list_inner_product(c.v, c.v)), 6) AS score
  FROM qd q, cd c),
best AS (
  SELECT question_id, unnest(min({{'s': -score, 'd': doc_id, 'c': chunk_no}}, {k})) AS h FROM scores GROUP BY question_id),
hits AS (
  SELECT question_id, h.d AS doc_id, h.c AS chunk_no, -h.s AS score,
         CAST(row_number() OVER (PARTITION BY question_id ORDER BY h) AS INTEGER) AS rank FROM best)"""


_CITED = """firsts AS (SELECT *, min(rank) OVER (PARTITION BY question_id, doc_id) AS first FROM hits),
cited AS (
  SELECT question_id, rank, CAST(dense_rank() OVER (PARTITION BY question_id ORDER BY first) AS INTEGER) AS citation,
         doc_id, chunk_no, d.source AS title, start, score, substring(passage, 1, 160) AS snippet, passage
  FROM firsts JOIN chunks USING (doc_id, chunk_no) JOIN documents d USING (doc_id))"""

QUESTIONS = """SELECT item_id AS question_id,
  CASE WHEN item_id % 9 = 4 THEN '???' WHEN item_id % 7 <> 3 THEN text END AS text FROM benchmark"""

ANSWERS = f"""{_retrieval(QUESTIONS, 5)},
{_CITED}"""

ALL_ANSWERS = f"""{_retrieval("SELECT item_id AS question_id, text FROM benchmark", 5)},
{_CITED}"""

TWO_CITED = f"""{_retrieval(QUESTIONS, 2)},
{_CITED}"""


NEIGHBOURS = """
SELECT q.vec_id AS question_id, p.vec_id,
       round(list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[])
             / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])
                    * list_inner_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])), 6) AS score,
       CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, p.vec_id) AS INTEGER) AS rank
FROM embeddings q JOIN embeddings p ON {condition}
QUALIFY rank <= 5"""

AGE = """CASE WHEN s >= 86400 THEN s // 86400 || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END
     WHEN s >= 3600 THEN s // 3600 || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
     WHEN s >= 60 THEN s // 60 || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END
     ELSE 'just now' END"""

CARD = f"""CASE status WHEN 'COMPLETED' THEN 'READY' WHEN 'FAILED' THEN 'FAILED' ELSE 'PROCESSING' END AS status,
CASE status WHEN 'COMPLETED' THEN 'Ready' WHEN 'FAILED' THEN 'Failed' ELSE 'Processing' END AS label,
{AGE} AS "uploadedAt\""""

WORDS = ["the", "estion", "queaux"]


def _bm25() -> str:
    counts = ", ".join(
        f"len(list_filter(found, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(WORDS)
    )
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(WORDS)))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / avg_length))"
        for i in range(len(WORDS))
    )
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(WORDS)))
    return f"""
WITH found AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{TERM_BREAK}'), lambda t: t <> '') AS found FROM documents),
counted AS (SELECT doc_id, len(found) AS length, {counts} FROM found),
totals AS (SELECT count(*) AS n, avg(length) AS avg_length, {dfs} FROM counted)
SELECT doc_id, round({score}, 6) AS score FROM counted, totals WHERE {hit} ORDER BY score DESC, doc_id LIMIT 50"""


SUMMARIES = f"""
WITH gappy AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 5 THEN text END AS text FROM documents),
cut AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda s: trim(s)),
                             lambda s: s <> '') AS cut FROM gappy),
df AS (
  SELECT bucket, count(*) AS n FROM (SELECT unnest(list_distinct({_buckets("text", 65536)})) AS bucket FROM gappy)
  GROUP BY bucket),
sentences AS (SELECT doc_id, unnest(cut) AS sentence, unnest(range(1, len(cut) + 1)) AS pos FROM cut),
hits AS (SELECT doc_id, pos, unnest({_buckets("sentence", 65536)}) AS bucket FROM sentences),
scores AS (
  SELECT doc_id, pos, round(sum(ln(((SELECT count(text) FROM gappy) + 1) / (n + 1))) / sqrt(count(*)), 6) AS score
  FROM hits JOIN df USING (bucket) GROUP BY ALL),
best AS (
  SELECT doc_id, pos, sentence FROM sentences LEFT JOIN scores USING (doc_id, pos)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, 0) DESC, pos) <= 3)
SELECT doc_id, coalesce(string_agg(sentence, ' ' ORDER BY pos), '') AS summary,
       coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos), '') AS positions
FROM documents LEFT JOIN best USING (doc_id) GROUP BY doc_id"""

def _term_list(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{TERM_BREAK}'), lambda t: t <> '')"


BEST_BY_TERMS = f"""
WITH gappy AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 5 THEN text END AS text FROM documents),
found AS (SELECT doc_id, coalesce({_term_list("text")}, []) AS found FROM gappy),
totals AS (SELECT count(*) AS n, avg(len(found)) AS mean FROM found),
tf AS (SELECT doc_id, len(found) AS length, term, count(*) AS c
       FROM (SELECT doc_id, found, unnest(found) AS term FROM found) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT question_id, unnest({_term_list("text")}) AS term FROM ({QUESTIONS})),
scores AS (
  SELECT question_id, doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), totals GROUP BY question_id, doc_id)
SELECT question_id, doc_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM scores QUALIFY rank <= 10"""

KEYLESS = """keyless AS (
  SELECT event_id, CASE WHEN event_type <> 'purchase' OR value >= 10 THEN user_id END AS user_id,
         CASE WHEN event_type <> 'click' OR value >= 5 THEN ts END AS ts, event_type, value, props FROM events)"""

QUOTA = f"""
WITH {KEYLESS}
SELECT event_id, user_id, ts, date_trunc('month', ts)::TIMESTAMP AS month,
       count(*) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id
                      ROWS UNBOUNDED PRECEDING) AS used, used > 50 AS "overLimit"
FROM keyless"""

MANIFEST_ERRORS = """
CASE WHEN source = 'src0' THEN 'fileName,fileSize,mimeType' ELSE
  array_to_string(list_filter([CASE WHEN lang = 'es' THEN 'fileName' END,
                               CASE WHEN lang IN ('fr', 'de') THEN 'fileSize' END], lambda f: f IS NOT NULL), ',') END"""

ORACLE: dict[str, str] = {
    "read_tables": f"""
WITH {ACCOUNTS}, {SESSIONS}, {DOCS}
SELECT 'accounts' AS stored, id, concat_ws('|', name, email, "emailVerified") AS content, "createdAt" FROM accounts
UNION ALL SELECT 'sessions', id, concat_ws('|', token, "userId", strftime("expiresAt", '%Y-%m-%d %H:%M:%S')), "createdAt" FROM sessions
UNION ALL SELECT 'documents', id, concat_ws('|', "fileName", "fileSize", "mimeType", "r2Key", coalesce("uploadId", '-'), status, "userId"), "createdAt"
FROM docs""",
    "read_upload_manifest": f"""
WITH {MANIFEST}
SELECT CASE WHEN source <> 'src0' AND lang <> 'es' THEN 'doc-' || doc_id || '.txt' END AS "fileName",
       CASE WHEN source = 'src0' OR lang = 'fr' THEN NULL WHEN lang = 'de' THEN n_chars + 0.5::DOUBLE
            ELSE n_chars::DOUBLE END AS "fileSize",
       CASE WHEN source <> 'src0' THEN 'text/plain' END AS "mimeType", source = 'src0' AS malformed, line FROM manifest""",
    "scan_document_files": """
SELECT 'doc_id=' || doc_id AS "userId", octet_length(encode(text)) + 1 AS "fileSize", sha256(text || chr(10)) AS hash
FROM documents""",
    "append_documents": f"""
WITH {DOCS} SELECT id, "fileName", "fileSize", "mimeType", "r2Key", "uploadId", status, "userId", "createdAt" FROM docs""",
    "validate_uploads": f"WITH {CHECKED} SELECT * FROM errors",
    "split_accepted": f"""
WITH {CHECKED}
SELECT "requestId", "userId", "fileName", CAST("fileSize" AS BIGINT) AS "fileSize", "mimeType"
FROM uploads WHERE "requestId" NOT IN (SELECT "requestId" FROM errors)""",
    "split_rejected": f"""
WITH {CHECKED}
SELECT "requestId", any_value("userId") AS "userId", any_value("fileName") AS "fileName",
       any_value("fileSize") AS "fileSize", any_value("mimeType") AS "mimeType", CAST(count(*) AS INTEGER) AS failed
FROM uploads JOIN errors USING ("requestId") GROUP BY "requestId\"""",
    "validate_accounts": f"""
WITH signups AS (
  SELECT c_custkey AS id, c_nationkey AS n, substring(c_name, 1, c_nationkey) AS name,
         CASE c_nationkey WHEN 1 THEN '.' || {EMAIL} WHEN 2 THEN replace({EMAIL}, '.', '..')
              WHEN 3 THEN replace({EMAIL}, '@', ' ') WHEN 4 THEN replace({EMAIL}, '.example', '.e')
              WHEN 5 THEN {EMAIL} || chr(10) WHEN 6 THEN NULL ELSE {EMAIL} END AS email FROM customer)
SELECT id, 'name' AS field, 'too_small' AS code FROM signups WHERE length(name) < 2
UNION ALL
SELECT id, 'email', CASE WHEN email IS NULL THEN 'invalid_type' ELSE 'invalid_format' END FROM signups
WHERE email IS NULL OR email LIKE '.%' OR email LIKE '%..%'
   OR NOT regexp_full_match(email, '[A-Za-z0-9_''+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*[.])+[A-Za-z]{{2,}}')""",
    "initialize_uploads": f"""
WITH {INTAKE}
SELECT id, "fileName", "fileSize", "mimeType", 'documents/' || "userId" || '/' || id AS "r2Key", 'PENDING_UPLOAD' AS status,
       "userId", {NOW} AS "createdAt" FROM fresh""",
    "initialize_upload_parts": f"""
WITH {INTAKE}
SELECT id, ("fileSize" + 65535) // 65536 AS "totalParts", CAST(p AS INTEGER) AS "partNumber", (p - 1) * 65536 AS "byteOffset",
       least(65536, "fileSize" - (p - 1) * 65536) AS "byteLength"
FROM (SELECT id, "fileSize", unnest(range(1, ("fileSize" + 65535) // 65536 + 1)) AS p FROM fresh)""",
    "search_documents_by_name": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'mall r')",
    "public_accounts": f"WITH {ACCOUNTS} SELECT id, name, email FROM accounts",
    "document_cards": f"""
WITH {DOCS}, aged AS (SELECT *, date_diff('second', "createdAt", {NOW}) AS s FROM docs)
SELECT id, "fileName" AS name, {CARD} FROM aged""",
    "recent_cards": f"""
WITH {LOG}, aged AS (
  SELECT *, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us("updatedAt")) // 1000000 AS s FROM newest)
SELECT id, "r2Key" AS name, {CARD} FROM aged""",
    "documents_of_account": f"""WITH {DOCS} SELECT id, "r2Key", status, "createdAt" FROM docs WHERE "userId" = '7'""",
    "documents_in_status": f"""
WITH {DOCS} SELECT id, status, "uploadId", "createdAt" FROM docs WHERE status IN ('PENDING_UPLOAD', 'PROCESSING')""",
    "lookup_by_key": f"""
WITH {ACCOUNTS} SELECT id, email FROM accounts WHERE id IN (SELECT CAST(user_id AS VARCHAR) FROM events)""",
    "new_accounts": f"""
WITH {SIGNUPS}
SELECT "requestId", name, email, token, "requestedAt" FROM signups WHERE email NOT IN (SELECT email FROM accounts)
QUALIFY row_number() OVER (PARTITION BY email ORDER BY "requestedAt", "requestId") = 1""",
    "sign_up_outcomes": f"""
WITH {SIGNUPS}
SELECT "requestId", CASE WHEN value >= 90 THEN 'invalid' WHEN "requestId" IN (SELECT "requestId" FROM granted) THEN 'created'
       ELSE 'exists' END AS outcome FROM signups""",
    "sign_up_rows": f"""
WITH {SIGNUPS}
SELECT sha256(email) AS "userId", name, email, FALSE AS "emailVerified", token,
       "requestedAt" + INTERVAL 7 DAY AS "expiresAt", "requestedAt" AS "createdAt" FROM granted""",
    "account_documents": f"""
WITH {ACCOUNTS}, {DOCS}
SELECT d.id, d."fileName", d.status, d."userId", a.name AS "userName", a.email AS "userEmail"
FROM docs d JOIN accounts a ON a.id = d."userId\"""",
    "account_sessions": f"""
WITH {ACCOUNTS}, {SESSIONS}
SELECT s.id, s."expiresAt", s."userId", a.name AS "userName" FROM sessions s JOIN accounts a ON a.id = s."userId\"""",
    "inactive_accounts": f"""
WITH {ACCOUNTS} SELECT id, name FROM accounts WHERE id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events)""",
    "cascade_delete": f"""
WITH {DOCS}, {SESSIONS} SELECT id, "userId", status FROM docs WHERE "userId" NOT IN (SELECT "userId" FROM sessions)""",
    "upsert_accounts": f"""
WITH {ACCOUNTS}, seen AS (SELECT CAST(user_id AS VARCHAR) AS id, max(ts) AS last FROM events GROUP BY 1)
SELECT id, name, "emailVerified", coalesce(last, "createdAt") AS "updatedAt" FROM accounts LEFT JOIN seen USING (id)""",
    "latest_document_state": f"WITH {LOG} SELECT * FROM newest",
    "abort_candidates": f"""
WITH {LOG}
SELECT id, "r2Key", "uploadId", coalesce("errorMessage", 'Upload initialization failed') AS "errorMessage"
FROM newest WHERE status = 'FAILED' AND "uploadId" IS NOT NULL""",
    "document_status_counts": f"""
WITH {DOCS} SELECT "userId", status, count(*) AS documents FROM docs GROUP BY ALL""",
    "document_status_table": f"""
WITH {DOCS}
SELECT "userId", count(*) FILTER (status = 'PENDING_UPLOAD') AS "PENDING_UPLOAD", CAST(0 AS BIGINT) AS "UPLOAD_INITIALIZED",
       CAST(0 AS BIGINT) AS "UPLOAD_COMPLETED", CAST(0 AS BIGINT) AS "QUEUED",
       count(*) FILTER (status = 'PROCESSING') AS "PROCESSING", count(*) FILTER (status = 'COMPLETED') AS "COMPLETED",
       CAST(0 AS BIGINT) AS "FAILED" FROM docs GROUP BY "userId\"""",
    "expired_sessions": f"""WITH {SESSIONS} SELECT * FROM sessions WHERE "expiresAt" < {NOW}""",
    "live_sessions": f"""WITH {SESSIONS} SELECT * FROM sessions WHERE "expiresAt" >= {NOW}""",
    "refresh_outcomes": f"""
WITH {REFRESH}
SELECT "requestId", outcome, "sessionId", "userId" FROM outcomes""",
    "rotate_sessions": f"""
WITH {REFRESH}
SELECT s.id, coalesce(a."newToken", s.token) AS token, s."userId",
       coalesce(a."requestedAt" + INTERVAL 7 DAY, s."expiresAt") AS "expiresAt", s."createdAt"
FROM sessions s LEFT JOIN (
  SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY token ORDER BY "requestedAt", "newToken") = 1) a
ON a.token = s.token""",
    "refresh_sessions": f"""
WITH {REFRESH}
SELECT s.id, coalesce(o."newToken", s.token) AS token, s."userId",
       coalesce(o."requestedAt" + INTERVAL 7 DAY, s."expiresAt") AS "expiresAt", s."createdAt"
FROM sessions s LEFT JOIN outcomes o ON o."sessionId" = s.id WHERE o.outcome IS NULL OR o.outcome = 'valid'""",
    "refresh_sessions_outcomes": f"""
WITH {REFRESH}
SELECT "requestId", "newToken", outcome, "sessionId", "userId" FROM outcomes""",
    "delete_sessions": f"""
WITH {REFRESH}
SELECT * FROM sessions
WHERE "expiresAt" >= {NOW} AND token NOT IN (SELECT token FROM asked WHERE token IS NOT NULL)""",
    "login_lookup": f"""
WITH {LOGINS}
SELECT "attemptId", email, CASE WHEN known THEN "userId" END AS "userId",
       CASE WHEN known THEN 'account' ELSE 'no_account' END AS outcome FROM attempts""",
    "log_in_sessions": f"""
WITH {SESSIONS}, {LOGINS},
granted AS (SELECT * FROM attempts WHERE known),
held AS (
  SELECT token, "userId", "expiresAt", "createdAt" FROM sessions
  UNION ALL SELECT token, "userId", "attemptedAt" + INTERVAL 7 DAY, "attemptedAt" FROM granted),
lasts AS (SELECT "userId", max("attemptedAt") AS last FROM granted GROUP BY 1)
SELECT held.* FROM held LEFT JOIN lasts USING ("userId") WHERE last IS NULL OR "expiresAt" >= last""",
    "plan_parts": """
WITH files AS (
  SELECT doc_id AS id, CASE doc_id % 30 WHEN 0 THEN 0 WHEN 10 THEN n_chars * 10000000 WHEN 20 THEN NULL ELSE n_chars END AS size
  FROM documents),
planned AS (
  SELECT *, (size + 999) // 1000 AS "totalParts",
         CASE WHEN size IS NULL THEN 'no_size' WHEN size = 0 THEN 'empty' WHEN size > 10000000 THEN 'too_many_parts' END AS error
  FROM files)
SELECT id, "totalParts", CAST(p AS INTEGER) AS "partNumber", (p - 1) * 1000 AS "byteOffset",
       least(1000, size - (p - 1) * 1000) AS "byteLength", error
FROM (SELECT *, unnest(range(1, "totalParts" + 1)) AS p FROM planned WHERE error IS NULL)
UNION ALL SELECT id, "totalParts", NULL, NULL, NULL, error FROM planned WHERE error IS NOT NULL""",
    "oversized_uploads": f"""WITH {DOCS} SELECT id, "fileSize" FROM docs WHERE ("fileSize" + 39) // 40 > 10000""",
    "part_manifest": """
WITH sent AS (
  SELECT l_orderkey, CASE l_quantity WHEN 1 THEN l_linenumber + 10000 WHEN 2 THEN -l_linenumber WHEN 3 THEN NULL ELSE l_linenumber END AS n,
         md5(CAST(l_partkey AS VARCHAR)) AS tag FROM lineitem),
parts AS (SELECT l_orderkey, n, max(tag) AS etag FROM sent GROUP BY ALL),
gathered AS (
  SELECT l_orderkey, string_agg(coalesce(CAST(n AS VARCHAR), '-') || ':' || etag, ',' ORDER BY n NULLS FIRST) AS parts,
         count(*) FILTER (n BETWEEN 1 AND 10000) AS good, count(*) AS total, max(n) AS last FROM parts GROUP BY l_orderkey)
SELECT l_orderkey AS "documentId", parts, good AS "receivedParts", total - good AS "invalidParts",
       CASE WHEN total > good THEN FALSE ELSE last = good END AS complete FROM gathered""",
    "extract_text": """
SELECT source AS "userId", CAST(doc_id AS VARCHAR) AS "documentId",
       'f' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.csv' ELSE '.pdf' END AS "fileName",
       CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN FALSE ELSE TRUE END AS decodable,
       CASE WHEN lang IN ('en', 'fr') THEN text END AS text FROM documents""",
    "classify_failures": f"""
WITH {LOG}
SELECT doc_id, status, CASE WHEN status IS NULL OR status <> 'FAILED' OR source = 'src0' THEN NULL WHEN lang = 'es' THEN 'CORRUPTED_FILE'
       WHEN lang = 'fr' THEN 'EMPTY_DOCUMENT' WHEN lang = 'de' THEN 'EMBEDDING_FAILED' ELSE 'PROCESSING_FAILED' END AS "failureReason"
FROM documents LEFT JOIN newest ON id = CAST(doc_id % 150 AS VARCHAR)""",
    "chunk_documents": f"WITH {CHUNKS} SELECT * FROM chunks",
    "chunk_lines": r"""
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, passage
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS passage,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
WHERE regexp_matches(passage, '\S')""",
    "term_search": _bm25(),
    "search_postings": BEST_BY_TERMS,
    "extractive_summaries": SUMMARIES,
    "embed_chunks": f"""
WITH {CHUNKS}, {WEIGHTS}, {_vectors("cv", "chunks", "doc_id, chunk_no", "passage")}
SELECT doc_id, chunk_no, CAST(bucket AS INTEGER) AS bucket, round(w, 4) AS weight FROM cv WHERE w <> 0""",
    "semantic_top_k": NEIGHBOURS.format(condition="TRUE"),
    "semantic_top_k_blocks": NEIGHBOURS.format(condition="TRUE"),
    "cell_search": f"SELECT * FROM ({NEIGHBOURS.format(condition='TRUE')}) WHERE rank = 1",
    "cell_search_all": NEIGHBOURS.format(condition="TRUE"),
    "cell_search_recall": "SELECT count(*) * least(5, count(*)) AS wanted, TRUE AS enough FROM embeddings",
    "scoped_search": NEIGHBOURS.format(condition="q.label = 0 OR q.label = p.label"),
    "scoped_search_blocks": NEIGHBOURS.format(condition="q.label = 0 OR q.label = p.label"),
    "answer_questions": f"WITH {ALL_ANSWERS} SELECT * FROM cited",
    "answer_from_unstored_texts": f"WITH {ANSWERS} SELECT * FROM cited",
    "cite_sources": f"WITH {TWO_CITED} SELECT * FROM cited",
    "question_context": f"""
WITH {ANSWERS},
summed AS (SELECT *, sum(length(passage)) OVER (PARTITION BY question_id ORDER BY rank) AS so_far FROM cited)
SELECT item_id AS question_id, CAST(count(*) FILTER (so_far <= 700) AS INTEGER) AS passages,
       CAST(coalesce(max(so_far) FILTER (so_far <= 700), 0) AS BIGINT) AS characters,
       coalesce(string_agg('[' || citation || '] ' || passage, chr(10) ORDER BY rank) FILTER (so_far <= 700), '') AS context
FROM benchmark LEFT JOIN summed ON question_id = item_id GROUP BY item_id""",
    "conversation_threads": """
SELECT conv_id, turn // 4 AS page, CAST(count(*) OVER (PARTITION BY conv_id, turn // 4) AS INTEGER) AS n_turns,
       turn, role, text FROM conversations""",
    "search_conversations": """
SELECT conv_id, count(*) AS matches, min(turn) AS first_turn FROM conversations
WHERE contains(lower(text), 'estion') GROUP BY conv_id""",
    "recent_conversations": """
SELECT event_id, user_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position
FROM events WHERE event_type = 'click' QUALIFY position <= 5""",
    "sources_per_conversation": f"""
WITH {_retrieval("SELECT conv_id || ':' || turn AS question_id, text FROM conversations WHERE role = 'user'", 3)}
SELECT CAST(split_part(question_id, ':', 1) AS BIGINT) AS conv_id, count(DISTINCT doc_id) AS sources FROM hits GROUP BY 1""",
    "monthly_quota": QUOTA,
    "product_totals": """
SELECT 'active_accounts' AS metric, count(DISTINCT user_id) AS value FROM events
UNION ALL SELECT 'documents_processed', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'questions_answered', count(*) FROM conversations WHERE role = 'user'""",
    "stream_validate_uploads": f"""
WITH {MANIFEST},
twice AS (SELECT *, 1 AS copy FROM manifest UNION ALL SELECT *, 2 FROM manifest WHERE lang <> 'es' AND doc_id % 3 = 0),
failed AS (SELECT line, doc_id, copy, {MANIFEST_ERRORS} AS fields FROM twice)
SELECT line, CASE WHEN fields <> '' THEN 'rejected' WHEN copy = 2 OR doc_id % 5 = 0 THEN 'repeated' ELSE 'accepted' END AS outcome,
       fields FROM failed""",
    "stream_latest_state": f"""
WITH {KEYLESS}, {LOG.replace("FROM events", "FROM keyless").replace('ORDER BY "updatedAt" DESC, seq DESC', 'ORDER BY "updatedAt" DESC NULLS LAST, seq DESC')}
SELECT * FROM newest""",
    "stream_dedup_uploads": f"""
WITH {KEYLESS}
SELECT DISTINCT 'documents/' || user_id || '/' || event_type AS "r2Key" FROM keyless WHERE user_id IS NOT NULL
UNION ALL SELECT 'documents/' || user_id || '/late-' || event_id FROM keyless WHERE event_id % 10 = 0
UNION ALL SELECT NULL FROM keyless WHERE user_id IS NULL""",
    "stream_dedup_within": f"""
WITH {KEYLESS},
sent AS (SELECT 'documents/' || user_id || '/' || event_type AS "r2Key", ts IS NULL AS untimed, FALSE AS late FROM keyless
         UNION ALL SELECT 'documents/' || user_id || '/late-' || event_id, ts IS NULL, TRUE FROM keyless WHERE event_id % 10 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY "r2Key", untimed, late) AS n FROM sent)
SELECT "r2Key", CASE WHEN untimed THEN 'untimed' WHEN late THEN 'late' WHEN n = 1 OR "r2Key" IS NULL THEN 'kept' ELSE 'repeated' END AS outcome,
       count(*) AS uploads FROM numbered GROUP BY ALL""",
    "stream_quota": f"""
WITH {KEYLESS}
SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS used, count(*) > 50 AS "overLimit" FROM keyless GROUP BY ALL""",
    "stream_quota_events": QUOTA,
    "stream_quota_crossings": f"""
WITH {KEYLESS},
spread AS (SELECT event_id, user_id, TIMESTAMP '2024-01-01' + (ts - TIMESTAMP '2024-01-01') * 4 AS ts FROM keyless WHERE ts IS NOT NULL),
counted AS (SELECT *, date_trunc('month', ts)::TIMESTAMP AS month,
                   row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS used FROM spread)
SELECT user_id, month, 'crossed' AS kind, used, event_id, ts FROM counted WHERE used = 11
UNION ALL SELECT user_id, month, 'closed', max(used), NULL, NULL FROM counted GROUP BY user_id, month
HAVING month + INTERVAL 1 MONTH < (SELECT max(ts) - INTERVAL 1 DAY FROM spread)""",
}
ORACLE |= {
    "search_indexed_names": ORACLE["search_documents_by_name"],
    "search_indexed_conversations": ORACLE["search_conversations"],
    "lookup_stored_keys": f"""
WITH {ACCOUNTS}
SELECT id, email, 'batch' AS way FROM accounts WHERE id IN (SELECT CAST(user_id AS VARCHAR) FROM events)
UNION ALL SELECT id, email, 'literal' FROM accounts WHERE "createdAt" = (SELECT max("createdAt") FROM accounts)""",
    "upsert_stored_accounts": ORACLE["upsert_accounts"],
    "delete_stored_accounts": ORACLE["inactive_accounts"],
    "sketched_totals": f"""
WITH {KEYLESS}
SELECT CAST(ts AS DATE) AS day, FALSE AS whole, count(*) AS events, count(DISTINCT user_id) AS accounts FROM keyless GROUP BY day
UNION ALL SELECT NULL, TRUE, count(*), count(DISTINCT user_id) FROM keyless""",
    "csv_passages": """
SELECT doc_id, 1 AS record_no, 'id: ' || doc_id || chr(10) || 'the "note": ' || text || chr(10) || 'lang: ' || lang AS passage FROM documents
UNION ALL SELECT doc_id, 2, 'id: ' || chr(10) || 'the "note": plain' || chr(10) || 'lang:  x' FROM documents""",
    "markdown_sections": """
WITH plain AS (SELECT doc_id, source, lang, translate(text, '#`~', '') AS body FROM documents)
SELECT doc_id, 1 AS section_no, 1 AS level, source AS path, trim(body, ' ' || chr(9) || chr(10) || chr(13)) AS passage FROM plain
UNION ALL SELECT doc_id, 2, 2, source || ' > ' || lang, '```' || chr(10) || '# not a heading' || chr(10) || body || chr(10) || '```' FROM plain
UNION ALL SELECT doc_id, 3, 3, source || ' > ' || lang || ' > Deep', 'end ' || doc_id FROM plain""",
    "file_passages": """
WITH records AS (
  SELECT doc_id, 'record 1' AS place, length('id: ' || doc_id || ' the "note": ' || text || ' lang: ' || lang) AS n FROM documents
  UNION ALL SELECT doc_id, 'record 2', length('id:  the "note": plain lang:  x') FROM documents),
pieces AS (SELECT *, greatest(CAST(ceil((n - 100) / 700.0) AS BIGINT), 1) AS k FROM records),
plain AS (SELECT doc_id, length(text) AS n, greatest(CAST(ceil((length(text) - 100) / 700.0) AS BIGINT), 1) AS k
          FROM documents WHERE doc_id % 11 <> 5 AND text <> '')
SELECT doc_id || '.CSV' AS "fileName", place, k AS passages, CAST(n + (k - 1) * 100 AS BIGINT) AS characters FROM pieces
UNION ALL SELECT doc_id || '.txt', 'character ' || s, 1, CAST(least(800, n - s) AS BIGINT)
FROM (SELECT *, unnest(range(0, k * 700, 700)) AS s FROM plain)""",
}
