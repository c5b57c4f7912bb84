"""DuckDB twins of the views, as common table expressions."""

# ruff: noqa: E501
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')"
FRAMING = "('what','why','how','when','where','who','which','is','are','was','were','do','does','did')"


def tok(column: str) -> str:
    return TOKENS.format(f"coalesce({column}, '')")


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def trim(text: str) -> str:
    return TRIM.format(text)


def title(text: str) -> str:
    full = rf"list_filter([{trim('x')} for x in string_split({text}, chr(10))], lambda y: y <> '')"
    heads = rf"list_filter([regexp_extract(x, '^#{{1,6}}[ \t]\s*(.*)$', 1) for x in {full}], lambda y: y <> '')"
    return f"substring(CASE WHEN len({heads}) > 0 THEN {heads}[1] ELSE coalesce({full}[1], '') END, 1, 256)"


PAGES = f"""pages_v AS (SELECT source AS scope, 'docs/' || doc_id AS page_id, 'wiki/docs/' || doc_id || '.md' AS path, {title('text')} AS title, text AS body,
  sha256(text) AS digest, ['docs:' || doc_id || '@sha256-' || substring(sha256(text), 1, 16)] AS source_refs, make_timestamp((1767225600 + doc_id) * 1000000) AS updated_at, doc_id FROM documents)"""
BODIES = """bodies AS (SELECT 'all' AS scope, 'docs/' || doc_id AS page_id, 'wiki/docs/' || doc_id || '.md' AS path,
  coalesce(text, '') || chr(10) || '[[wiki/docs/' || ((doc_id * 7 + 3) % 1100) || '.md|x]] [[../bad]] [[ docs/' || ((doc_id * 11 + 5) % 500) || '#a]]' || CASE WHEN doc_id % 7 = 0 THEN ' [[open' ELSE '' END AS body, doc_id FROM documents)"""


def normal(target: str) -> str:
    name = rf"regexp_replace({trim(f"regexp_replace({target}, '^wiki/', '')")}, '\.md$', '')"
    return f"(CASE WHEN {name} IN ('', '.') OR starts_with({name}, '/') OR starts_with({name}, '../') OR contains({name}, '/../') THEN '' ELSE {name} END)"


def targets(text: str) -> str:
    x = rf"regexp_extract({trim('x')}, '(?s)^([^|#]*)', 1)"
    return rf"list_filter([{normal(x)} for x in regexp_extract_all({text}, '(?s)\[\[(.*?)\]\]', 1)], lambda y: y <> '')"


LINKS = f"{BODIES}, links_v AS (SELECT DISTINCT scope, page_id AS from_page, unnest({targets('body')}) AS to_page, 'wiki' AS relation FROM bodies)"
POSTINGS = f"""{PAGES}, toks AS (SELECT scope, page_id, unnest({tok('title')}) AS term, 1 AS t FROM pages_v UNION ALL SELECT scope, page_id, unnest({tok('body')}), 0 FROM pages_v),
post AS (SELECT scope, page_id, term, CAST(sum(t) AS BIGINT) AS tf_title, CAST(sum(1 - t) AS BIGINT) AS tf_body FROM toks GROUP BY ALL),
dls AS (SELECT scope, page_id, CAST(len({tok('title')}) + len({tok('body')}) AS BIGINT) AS dl FROM pages_v)"""


def scored(terms: list[str]) -> str:
    """page_id, path, scope, matched, score over the pages that hold a term."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{POSTINGS}, stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM dls), hits AS (SELECT *, 8.0 * tf_title + tf_body AS tf FROM post WHERE term IN ({listed})),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term), scored AS (SELECT scope, page_id, path, title, body, CAST(count(*) AS INT) AS matched,
  round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM hits JOIN dfs USING (term) JOIN dls USING (scope, page_id) JOIN pages_v USING (scope, page_id) CROSS JOIN stats GROUP BY scope, page_id, path, title, body)"""


def excerpt(title_: str, body: str, terms: list[str], limit: int) -> str:
    """A scalar subquery over one row's whole text."""
    either = "|".join(sorted(terms, key=len, reverse=True))
    inner = r"[^\p{L}\p{N}\p{M}]"
    whole = trim(f"{title_} || chr(10) || {body}")
    return rf"""(WITH a AS (SELECT {whole} AS w), b AS (SELECT w, length(w) AS n, length(regexp_extract(lower(w), '(?s)^((?:.*?{inner})??)({either})(?:{inner}|$)', 1)) AS pos,
  length(regexp_extract(lower(w), '(?s)^((?:.*?{inner})??)({either})(?:{inner}|$)', 2)) AS size FROM a), c AS (SELECT *, pos + size AS e, {limit} - size AS room FROM b),
  d AS (SELECT *, (room >= 2 AND pos > 0 AND e < n) OR (room >= 1 AND pos > 0 AND e < n AND pos >= n - e) OR (room >= 1 AND pos > 0 AND NOT e < n) AS lead,
    (room >= 2 AND pos > 0 AND e < n) OR (room >= 1 AND pos > 0 AND e < n AND room < 2 AND pos < n - e) OR (room >= 1 AND e < n AND NOT pos > 0) AS trail FROM c),
  f AS (SELECT *, room - lead::INT - trail::INT AS ctx FROM d), g AS (SELECT *, least(ctx // 2, pos) AS before0 FROM f), h AS (SELECT *, least(ctx - before0, n - e) AS after FROM g),
  i AS (SELECT *, before0 + least(greatest(ctx - before0 - after, 0), pos - before0) AS before FROM h)
  SELECT CASE WHEN n <= {limit} THEN w WHEN size = 0 THEN substring(w, 1, {limit - 1}) || '…' WHEN size >= {limit} THEN substring(w, pos + 1, {limit})
    ELSE (CASE WHEN lead AND pos - before > 0 THEN '…' ELSE '' END) || substring(w, pos - before + 1, before + size + after) || (CASE WHEN trail AND e + after < n THEN '…' ELSE '' END) END FROM i)"""


EVENTS = """events_v AS (SELECT user_id AS op, ts, event_id, CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'review' WHEN 'purchase' THEN 'apply' WHEN 'error' THEN 'fail' ELSE 'commit' END AS event FROM events)"""
#: The state machine, a step for each event.
_NEXT = """CASE WHEN {e} = 'plan' AND {s} = 'received' THEN 'planned' WHEN {e} = 'review' AND {s} = 'planned' THEN 'awaiting_review' WHEN {e} = 'apply' AND {s} IN ('planned', 'awaiting_review') THEN 'applying'
 WHEN {e} = 'commit' AND {s} = 'applying' THEN 'committed' WHEN {e} = 'fail' AND {s} IN ('received', 'planned', 'awaiting_review', 'applying') THEN 'failed' ELSE {s} END"""
STATES = f"""WITH RECURSIVE {EVENTS}, ordered AS MATERIALIZED (SELECT op, event, row_number() OVER (PARTITION BY op ORDER BY ts, event_id) AS i FROM events_v),
fold AS (SELECT op, CAST(0 AS BIGINT) AS i, 'received' AS s, 0 AS n FROM (SELECT DISTINCT op FROM ordered)
  UNION ALL SELECT op, i, new, n + (new <> s)::INT FROM (SELECT o.op, o.i, f.s, f.n, {_NEXT.format(e='o.event', s='f.s')} AS new FROM fold f JOIN ordered o ON o.op = f.op AND o.i = f.i + 1)),
final AS (SELECT op, arg_max(s, i) AS status, CAST(arg_max(n, i) AS BIGINT) AS applied, CAST(max(i) AS BIGINT) AS n_events FROM fold GROUP BY op)"""
ENVELOPES = """copies AS (SELECT conv_id, turn, text, unnest([0, 1]) AS copy FROM conversations), contents AS (SELECT *, CASE WHEN copy = 1 AND (conv_id * 31 + turn) % 9 = 0 THEN text || ' (changed)' ELSE text END AS content FROM copies),
env AS (SELECT CAST(conv_id AS VARCHAR) AS source_id, CAST(turn AS VARCHAR) AS version, sha256(content) AS digest, copy FROM contents)"""
OPS = """ops AS (SELECT 'op-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS operation_id, 'scope-' || (o_orderkey % 3) AS scope,
  ['received', 'planned', 'awaiting_review', 'applying', 'committed', 'failed'][CAST(o_orderkey % 6 + 1 AS INT)] AS status,
  CASE WHEN o_orderkey % 6 = 5 THEN 'source: broken' END AS failure, CASE WHEN o_orderkey % 6 = 4 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS generation,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'text/plain' END AS media_type,
  CASE WHEN o_orderkey % 13 = 0 THEN '/abs/manifest.yaml' WHEN o_orderkey % 17 = 0 THEN 'raw/../x' ELSE 'raw/' || o_orderkey || '/manifest.yaml' END AS manifest_ref,
  '# Schema ' || (o_orderkey % 5) AS schema_text, CASE WHEN o_orderkey % 19 = 0 THEN repeat('a', 64) ELSE sha256('# Schema ' || (o_orderkey % 5)) END AS schema_digest,
  CASE WHEN o_orderkey % 4 = 0 THEN 't' || o_orderkey ELSE '' END AS work_token,
  CASE WHEN o_orderkey % 4 = 0 THEN make_timestamp((1767225600 + o_orderkey % 1000) * 1000000) END AS work_expires_at,
  make_timestamp((1767225600 + (o_orderkey * 37) % 5000) * 1000000) AS work_ready_at, make_timestamp((1767225600 + (o_orderkey * 53) % 7000) * 1000000) AS created_at, CAST(o_orderkey % 3 AS INT) AS work_attempt FROM orders)"""
COMPLETE = "media_type <> ''"
VALID = "media_type <> '' AND NOT starts_with(manifest_ref, '/') AND NOT contains(manifest_ref, '/../') AND schema_digest = sha256(schema_text)"
NOW = "TIMESTAMP '2026-01-01 00:08:20'"
FREE = f"(work_token = '' OR work_expires_at <= {NOW})"
