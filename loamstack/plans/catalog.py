"""The registered queries of the engine and their DuckDB twins."""

# ruff: noqa: E501
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.functions import identity, lexical, markdown
from loamstack.operators import acceptance, batch, edits, evidence, graph, lint, refcounts, search, work
from loamstack.plans import oracles as O
from loamstack.plans import shared
from loamstack.plans import views as V
from loamstack.sinks import text
from loamstack.sinks.projection import snapshot_digest
from loamstack.sources import bootstrap

TERMS = ["thing", "nation", "ering"]
#: Terms that some pages hold all of.
FREQUENT = ["thes", "erre", "at"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- tokens and terms


@_query(f"SELECT term, count(*) AS n FROM (SELECT unnest({O.tok('text')}) AS term FROM documents) GROUP BY term")
def tokenize_term_counts(spark, d):
    return V.table(spark, d, "documents").select(F.explode(lexical.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


_TERMS_OF = f"list_distinct(list_filter({O.tok('text')}, lambda x: x NOT IN {O.FRAMING}))"


@_query(
    f"SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(list_sort(t), ' ') AS terms, len(t) BETWEEN 1 AND 32 AND coalesce(list_sum([length(x) for x in t]), 0) <= 256 AS valid FROM (SELECT *, {_TERMS_OF} AS t FROM conversations)"
)
def normalize_query_terms(spark, d):
    rows = V.table(spark, d, "conversations").withColumn("t", lexical.content_terms(F.col("text")))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n_terms"), F.array_join(F.array_sort("t"), " ").alias("terms"), lexical.valid_query(F.col("t")).alias("valid"))


@_query(
    f"""WITH {O.PAGES}, parts AS (SELECT doc_id, concat_ws(' ', title, body) AS p FROM pages_v), toks AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM (SELECT doc_id, {O.tok('p')} AS t FROM parts)),
firsts AS (SELECT doc_id, term, min(i) AS i FROM toks WHERE term NOT IN {O.FRAMING} AND length(term) <= 256 GROUP BY ALL),
run AS (SELECT doc_id, term, i, row_number() OVER w AS n, sum(length(term)) OVER w AS r FROM firsts WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT p.doc_id, coalesce(string_agg(term, ' ' ORDER BY i), '') AS terms, count(term) AS n_terms FROM pages_v p LEFT JOIN (SELECT * FROM run WHERE n <= 32 AND r <= 256) q ON p.doc_id = q.doc_id GROUP BY p.doc_id"""
)
def summarize_terms(spark, d):
    rows = V.pages(spark, d).withColumn("t", lexical.summary_terms(F.col("title"), F.col("body")))
    return rows.select(F.substring_index("page_id", "/", -1).cast("long").alias("doc_id"), F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n_terms"))


@_query(f"WITH {O.POSTINGS} SELECT * FROM post")
def postings_build(spark, d):
    return search.postings(V.pages(spark, d))


@_query(f"WITH {O.POSTINGS} SELECT * FROM dls")
def doc_lengths(spark, d):
    return search.doc_lengths(V.pages(spark, d))


# --- search

_SCORED = f"WITH {O.scored(TERMS)} "


@_query(_SCORED + "SELECT scope, page_id, matched, score FROM scored")
def bm25_scores(spark, d):
    return search.matches(V.pages(spark, d), TERMS).select("scope", "page_id", "matched", "score")


@_query(_SCORED + "SELECT scope, page_id, matched, score FROM scored")
def bm25_scores_indexed(spark, d):
    pages = V.pages(spark, d)
    return search.indexed_matches(search.postings(pages), search.doc_lengths(pages), TERMS)


@_query(f"WITH {O.scored(FREQUENT)} SELECT page_id, path, score FROM scored WHERE matched = 3 ORDER BY score DESC, path LIMIT 20")
def search_strict_and(spark, d):
    return search.ranked(search.strict_matches(V.pages(spark, d), FREQUENT), 3, 20).select("page_id", "path", "score")


@_query(_SCORED + "SELECT page_id, path, score FROM scored ORDER BY score DESC, path LIMIT 20")
def search_relaxed_or(spark, d):
    return search.matches(V.pages(spark, d), TERMS).orderBy(F.desc("score"), "path").limit(20).select("page_id", "path", "score")


_TWO = "SELECT page_id, path, title, matched = 3 AS strict, score FROM scored {} ORDER BY strict DESC, score DESC, path LIMIT {}"


@_query(_SCORED + _TWO.format("", 20))
def search_two_phase(spark, d):
    return search.ranked(search.matches(V.pages(spark, d), TERMS), 3, 20).select("page_id", "path", "title", "strict", "score")


@_query(_SCORED + _TWO.format("WHERE scope = 'src3'", 5))
def search_scoped(spark, d):
    return search.search(V.pages(spark, d), "src3", TERMS, 5, 64).select("page_id", "path", "title", "strict", "score")


@_query(f"WITH {O.scored(['the'])} SELECT page_id, path, score FROM scored ORDER BY score DESC, path LIMIT 100")
def search_topk_ties(spark, d):
    return search.ranked(search.matches(V.pages(spark, d), ["the"]), 1, 100).select("page_id", "path", "score")


@_query(_SCORED + "SELECT CAST(row_number() OVER (ORDER BY matched = 3 DESC, score DESC, path, page_id) - 1 AS INT) AS place, page_id, path, matched = 3 AS strict, score FROM scored QUALIFY place < 20")
def search_top_from_blocks(spark, d):
    """The two-phase top k from a written index, without a read of any text."""
    pages = V.pages(spark, d).withColumn("scope", F.lit("all"))
    return shared.written_index(pages).best("all", TERMS, 20)


#: Questions: the first line's terms of every document whose id is divisible by 20; BM25 of all pages that hold a term.
_ASKED = f"""{O.POSTINGS}, qs AS (SELECT doc_id AS question, scope, page_id, {O.tok('title')} AS t FROM pages_v WHERE doc_id % 20 = 0),
qtok AS (SELECT question, scope, unnest(t) AS term, unnest(range(len(t))) AS i FROM qs),
qf AS (SELECT question, scope, term, min(i) AS i FROM qtok WHERE term NOT IN {O.FRAMING} AND length(term) <= 256 GROUP BY ALL),
qr AS (SELECT question, scope, term, row_number() OVER w AS n, sum(length(term)) OVER w AS r FROM qf WINDOW w AS (PARTITION BY question ORDER BY i)),
qt AS (SELECT question, scope, term, count(*) OVER (PARTITION BY question) AS n_terms FROM qr WHERE n <= 32 AND r <= 256),
stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM dls), dfs AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (SELECT question, p.scope, p.page_id, 'wiki/' || p.page_id || '.md' AS path, count(*) = max(n_terms) AS strict,
  round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (8.0 * tf_title + tf_body) * 2.2 / ((8.0 * tf_title + tf_body) + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM qt JOIN post p ON p.term = qt.term{{scope}} JOIN dfs ON dfs.term = qt.term JOIN dls ON dls.scope = p.scope AND dls.page_id = p.page_id CROSS JOIN stats GROUP BY question, p.scope, p.page_id),
best AS (SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY strict DESC, score DESC, path, page_id) - 1 AS INT) AS place, page_id, strict, score FROM sc)"""


def _questions_of_all(pages):
    return pages.select(F.substring_index("page_id", "/", -1).cast("long").alias("question"), "scope", lexical.summary_terms(F.col("title")).alias("terms"), F.col("page_id").alias("wanted"))


def _questions(pages):
    return _questions_of_all(pages.where(F.substring_index("page_id", "/", -1).cast("long") % 20 == 0))


@_query("WITH " + _ASKED.replace("{scope}", " AND p.scope = qt.scope") + " SELECT question, place, page_id, strict, score FROM best WHERE place < 5")
def search_batch(spark, d):
    pages = V.pages(spark, d)
    return shared.written_index(pages).top(_questions(pages), 5).select("question", "place", "page_id", "strict", "score")


@_query("WITH " + _ASKED.replace(" WHERE doc_id % 20 = 0", "").replace("{scope}", " AND p.scope = qt.scope") + ", hit AS (SELECT question, bool_or(best.page_id = qs.page_id AND place < 5) AS hit FROM qs LEFT JOIN best USING (question) GROUP BY question) SELECT count(*) AS queries, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) >= ceil(count(*) * 0.85) AS passed FROM hit")
def retrieval_gate(spark, d):
    """How many of all documents their own first line finds among the first five hits of their scope."""
    pages = V.pages(spark, d)
    return batch.retrieval_gate(shared.written_index(pages), _questions_of_all(pages), 5, 0.85)


def _excerpt(limit: int) -> str:
    return f"WITH {O.PAGES} SELECT page_id, {O.excerpt('title', 'body', TERMS, limit)} AS snippet FROM pages_v"


@_query(_excerpt(64))
def excerpt_bounded(spark, d):
    return V.pages(spark, d).select("page_id", lexical.excerpt(F.col("title"), F.col("body"), TERMS, 64).alias("snippet"))


@_query(_excerpt(8))
def excerpt_narrow(spark, d):
    return V.pages(spark, d).select("page_id", lexical.excerpt(F.col("title"), F.col("body"), TERMS, 8).alias("snippet"))


@_query(f"SELECT doc_id, len(list_intersect({O.tok('text')}, ['thing', 'nation', 'ering'])) > 0 AS found FROM documents")
def contains_term(spark, d):
    return V.table(spark, d, "documents").select("doc_id", lexical.contains_term(F.col("text"), TERMS).alias("found"))


# --- identities and Markdown

_HEADED = "CASE doc_id % 4 WHEN 0 THEN text || chr(10) || '  ## Heading ' || doc_id WHEN 1 THEN chr(10) || '#NoSpace' || chr(10) || text WHEN 2 THEN '####### seven' || chr(10) || text ELSE text END"


@_query(f"SELECT doc_id, {O.title(_HEADED)} AS title FROM documents")
def source_title(spark, d):
    t, i = F.col("text"), F.col("doc_id")
    headed = F.when(i % 4 == 0, F.concat(t, F.lit("\n  ## Heading "), i)).when(i % 4 == 1, F.concat(F.lit("\n#NoSpace\n"), t)).when(i % 4 == 2, F.concat(F.lit("####### seven\n"), t)).otherwise(t)
    return V.table(spark, d, "documents").select("doc_id", markdown.source_title(headed).alias("title"))


@_query("SELECT doc_id, sha256(text) AS digest, substring(sha256(text), 1, 32) AS token FROM documents")
def page_digest(spark, d):
    return V.table(spark, d, "documents").select("doc_id", identity.digest(F.col("text").cast("binary")).alias("digest"), identity.token(F.col("text")).alias("token"))


_PATH = "CASE doc_id % 8 WHEN 0 THEN 'wiki/docs/' || doc_id || '.md' WHEN 1 THEN 'wiki/index.md' WHEN 2 THEN 'wiki/log.md' WHEN 3 THEN 'raw/' || doc_id || '.md' WHEN 4 THEN 'wiki/../' || doc_id || '.md' WHEN 5 THEN ' wiki/a/' || doc_id || '.md ' WHEN 6 THEN 'wiki/' || doc_id || '.md.md' ELSE 'wiki/' || doc_id || '.txt' END"
_NAME = r"regexp_extract(c, '(?s)^wiki/(.*)\.md$', 1)"


@_query(
    f"SELECT doc_id, path, CASE WHEN {_NAME} <> '' AND c NOT IN ('wiki/index.md', 'wiki/log.md') AND {O.normal(_NAME)} = {_NAME} THEN {_NAME} END AS page_id FROM (SELECT doc_id, path, {O.trim('path')} AS c FROM (SELECT doc_id, {_PATH} AS path FROM documents))"
)
def page_id_from_path(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path")).withColumn("page_id", markdown.page_id(F.col("path")))


_TARGET = "CASE doc_id % 7 WHEN 0 THEN 'wiki/docs/' || doc_id || '.md' WHEN 1 THEN '../' || doc_id WHEN 2 THEN '/abs/' || doc_id WHEN 3 THEN 'a/../' || doc_id WHEN 4 THEN '.' WHEN 5 THEN '  spaced ' || doc_id || ' ' ELSE '.md' END"


@_query(f"SELECT doc_id, {O.normal('t')} AS target FROM (SELECT doc_id, {_TARGET} AS t FROM documents)")
def normalize_target(spark, d):
    return V.table(spark, d, "documents").select("doc_id", markdown.normal_target(F.expr(_TARGET)).alias("target"))


@_query(
    "SELECT doc_id, source || ':' || doc_id || '@' || lang AS ref, 'kb:' || source || ':' || doc_id || '@' || lang || '#' || substring(sha256(text), 1, 16) AS operation_id, 'raw/' || substring(sha256('kb' || chr(0) || source || chr(0) || doc_id), 1, 32) || '/' || substring(sha256(lang), 1, 32) AS location FROM documents"
)
def identity_keys(spark, d):
    i, found = F.col("doc_id").cast("string"), identity.digest(F.col("text").cast("binary"))
    kb = F.lit("kb")
    return V.table(spark, d, "documents").select("doc_id", identity.source_ref(F.col("source"), i, F.col("lang")).alias("ref"), identity.operation_id(kb, F.col("source"), i, F.col("lang"), found).alias("operation_id"), identity.raw_location(kb, F.col("source"), i, F.col("lang")).alias("location"))


@_query(
    "SELECT conv_id, turn, adapter, CASE WHEN origin <> '' THEN origin ELSE 'source-' || substring(g, 1, 16) END AS source_id, 'sha256-' || substring(g, 1, 16) AS version, g AS digest, kind AS accepted_type, valid FROM (SELECT *, sha256(body) AS g FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'uri' ELSE 'inline' END AS adapter, CASE WHEN turn % 3 = 2 THEN 'https://x.test/' || conv_id WHEN turn % 3 = 1 THEN 'o' || conv_id ELSE '' END AS origin, CASE WHEN turn % 3 = 2 THEN 'https://x.test/' || conv_id ELSE text END AS body, CASE WHEN turn % 3 = 2 THEN 'text/uri-list' WHEN turn % 2 = 1 THEN 'text/markdown' ELSE 'text/plain' END AS kind, true AS valid FROM conversations))"
)
def envelope_decode(spark, d):
    t = F.col("turn") % 3
    rows = V.table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(t != 2, F.col("text")).alias("content"), F.when(t == 2, F.concat(F.lit("https://x.test/"), F.col("conv_id"))).alias("uri"),
        F.when((t != 2) & (F.col("turn") % 2 == 1), "text/markdown").otherwise("  ").alias("media_type"), F.when(t == 1, F.concat(F.lit(" o"), F.col("conv_id"))).otherwise("").alias("origin"), F.lit("").alias("idempotency_key"),
    )
    return acceptance.decoded(rows).select("conv_id", "turn", "adapter", "source_id", "version", "digest", "accepted_type", "valid")


@_query(f"WITH {O.LINKS} SELECT * FROM links_v")
def wiki_links_extract(spark, d):
    return V.links(spark, d)


@_query(rf"WITH {O.BODIES} SELECT page_id, contains(regexp_replace(body, '(?s)\[\[(.*?)\]\]', ' ', 'g'), '[[') AS malformed FROM bodies")
def links_malformed(spark, d):
    return V.linked_pages(spark, d).select("page_id", markdown.unclosed(F.col("body")).alias("malformed"))


_INDEX = "'# Index' || chr(10) || '- [[docs/' || doc_id || '|T]]' || chr(10) || '- docs/' || (doc_id + 1) || '.md'"


@_query(
    f"SELECT doc_id, target FROM (SELECT doc_id, unnest(list_concat({O.targets('body')}, list_filter([{O.normal(O.trim('substring(x, 3)'))} for x in list_filter([{O.trim('y')} for y in string_split(body, chr(10))], lambda z: starts_with(z, '- '))], lambda v: v <> ''))) AS target FROM (SELECT doc_id, {_INDEX} AS body FROM documents))"
)
def index_targets(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.explode(markdown.index_targets(F.expr(_INDEX.replace("chr(10)", "char(10)")))).alias("target"))


# --- graph

_SEEDS = "seeds AS (SELECT 'all' AS scope, page_id, CAST(row_number() OVER (ORDER BY matched = 3 DESC, score DESC, path, page_id) - 1 AS INT) AS ordinal FROM scored QUALIFY ordinal < 20)"
_BOTH = "both_v AS (SELECT scope, from_page AS page_id, to_page AS other FROM links_v UNION ALL SELECT scope, to_page, from_page FROM links_v)"


@_query(f"WITH {O.LINKS} SELECT from_page, to_page, relation FROM links_v WHERE from_page = 'docs/3' OR to_page = 'docs/3' ORDER BY ALL LIMIT 100")
def links_both_directions(spark, d):
    return graph.page_links(V.links(spark, d), "all", "docs/3", 100)


@_query(f"WITH {O.LINKS}, {O.PAGES} SELECT 'all' AS scope, from_page, to_page, relation FROM links_v WHERE to_page NOT IN (SELECT page_id FROM pages_v)")
def links_broken(spark, d):
    return graph.broken(V.links(spark, d), V.linked_pages(spark, d)).select("scope", "from_page", "to_page", "relation")


@_query(f"WITH {O.scored(FREQUENT)}, {O.LINKS}, {_SEEDS}, {_BOTH} SELECT b.scope, other AS page_id, 'wiki/' || other || '.md' AS path, min(ordinal) AS rank FROM both_v b JOIN seeds USING (scope, page_id) WHERE other <> page_id AND other IN (SELECT page_id FROM bodies) GROUP BY ALL")
def neighbors_one_hop(spark, d):
    hits = search.ranked(search.matches(V.pages(spark, d), FREQUENT), 3, 20)
    return graph.neighbours(graph.seeded(hits, "all"), V.links(spark, d), V.linked_pages(spark, d)).select("scope", "page_id", "path", "rank")


@_query(f"WITH {O.PAGES} SELECT page_id, path, updated_at FROM pages_v WHERE scope = 'src1' AND page_id NOT IN ('docs/1', 'docs/21') ORDER BY updated_at DESC, path LIMIT 10")
def recent_pages_excluding(spark, d):
    return graph.recent(V.pages(spark, d), "src1", ["docs/1", "docs/21"], 10)


_LISTED = "listed AS (SELECT 'all' AS scope, 'docs/' || doc_id AS page_id FROM documents WHERE doc_id % 2 = 0)"


def _listed(spark, d):
    return V.table(spark, d, "documents").where("doc_id % 2 = 0").select(F.lit("all").alias("scope"), F.concat(F.lit("docs/"), F.col("doc_id")).alias("page_id"))


@_query(f"WITH {O.LINKS}, {_LISTED} SELECT scope, page_id FROM bodies WHERE page_id NOT IN (SELECT to_page FROM links_v) AND page_id NOT IN (SELECT page_id FROM listed)")
def orphans(spark, d):
    return graph.orphans(V.linked_pages(spark, d), V.links(spark, d), _listed(spark, d))


@_query(f"WITH {O.BODIES}, {_LISTED} SELECT scope, page_id FROM bodies WHERE page_id NOT IN (SELECT page_id FROM listed)")
def index_missing(spark, d):
    return V.linked_pages(spark, d).select("scope", "page_id").join(_listed(spark, d), ["scope", "page_id"], "left_anti")


@_query(
    f"""WITH {O.LINKS}, mentions AS (SELECT 'docs/' || (doc_id * 2) AS page_id FROM documents)
SELECT 'index.broken_page' AS code, 'wiki/index.md' AS path, page_id, NULL AS ref FROM mentions WHERE page_id NOT IN (SELECT page_id FROM bodies)
UNION ALL SELECT 'index.missing_page', 'wiki/index.md', page_id, NULL FROM bodies WHERE page_id NOT IN (SELECT page_id FROM mentions)
UNION ALL SELECT 'page.orphan', path, page_id, NULL FROM bodies WHERE page_id NOT IN (SELECT page_id FROM mentions) AND page_id NOT IN (SELECT to_page FROM links_v)
UNION ALL SELECT 'link.broken', NULL, from_page, to_page FROM links_v WHERE to_page NOT IN (SELECT page_id FROM bodies)"""
)
def lint_links_incremental(spark, d):
    """Counts of an earlier text and an earlier index, and an edit of every page and of the index: what the findings are after it."""
    new, mention = V.linked_pages(spark, d), lambda i: V.table(spark, d, "documents").select(F.lit("all").alias("scope"), F.concat(F.lit("docs/"), i).alias("page_id"))
    i = F.substring_index("page_id", "/", -1).cast("long")
    old = new.withColumn("body", F.concat(F.lit("[[docs/"), i * 5 % 700, F.lit("]] [[docs/"), i + 1, F.lit("]]\n"), F.col("body")))
    before = refcounts.contributions(old, mention(F.col("doc_id") * 3))
    delta = refcounts.contributions(new, mention(F.col("doc_id") * 2)).unionByName(refcounts.contributions(old, mention(F.col("doc_id") * 3), -1))
    found = refcounts.counted_findings(before.unionByName(delta), V.links(spark, d))
    return found.select("code", "path", "page_id", F.array_join("refs", ",").alias("ref"))


_CONTEXT = f"""WITH {O.scored(FREQUENT)}, {O.LINKS}, {_BOTH}, c AS (SELECT 'all' AS scope, page_id, row_number() OVER (ORDER BY matched = 3 DESC, score DESC, path, page_id) - 1 AS ordinal FROM scored QUALIFY ordinal < {graph.candidate_quota(20)}),
near AS (SELECT other AS page_id, min(ordinal) AS rank FROM both_v JOIN c USING (scope, page_id) WHERE other <> page_id AND other IN (SELECT page_id FROM pages_v) GROUP BY ALL),
n AS (SELECT page_id, row_number() OVER (ORDER BY rank, 'wiki/' || page_id || '.md') AS i FROM near WHERE page_id NOT IN (SELECT page_id FROM c)),
have AS (SELECT 0 AS phase, ordinal AS i, page_id FROM c UNION ALL SELECT 1, i, page_id FROM n WHERE i <= 19 - (SELECT count(*) FROM c) UNION ALL SELECT 2, 0, 'index'),
late AS (SELECT 3 AS phase, row_number() OVER (ORDER BY updated_at DESC, path) AS i, page_id FROM pages_v WHERE page_id NOT IN (SELECT page_id FROM have))
SELECT CAST(row_number() OVER (ORDER BY phase, i) - 1 AS INT) AS place, page_id FROM (SELECT * FROM have UNION ALL SELECT * FROM late) QUALIFY place < 20"""


@_query(_CONTEXT)
def context_select(spark, d):
    pages = V.pages(spark, d).withColumn("scope", F.lit("all"))
    return graph.context_pages(pages, V.links(spark, d), "all", FREQUENT, 20)


@_query(
    "WITH " + _ASKED.replace("{scope}", "") + f""", {O.LINKS}, {_BOTH}, c AS (SELECT question, page_id, place AS ordinal FROM best WHERE place < {graph.candidate_quota(20)}),
near AS (SELECT question, other AS page_id, min(ordinal) AS rank FROM both_v b JOIN c ON b.page_id = c.page_id WHERE other <> b.page_id AND other IN (SELECT page_id FROM pages_v) GROUP BY ALL),
n AS (SELECT question, page_id, row_number() OVER (PARTITION BY question ORDER BY rank, 'wiki/' || page_id || '.md') AS i FROM near ANTI JOIN c USING (question, page_id)),
have AS (SELECT question, 0 AS phase, ordinal AS i, page_id FROM c UNION ALL SELECT question, 1, i, page_id FROM n LEFT JOIN (SELECT question, count(*) AS k FROM c GROUP BY question) USING (question) WHERE i <= 19 - coalesce(k, 0)
  UNION ALL SELECT question, 2, 0, 'index' FROM qs),
late AS (SELECT question, 3 AS phase, i, page_id FROM (SELECT q.question, r.i, r.page_id FROM qs q CROSS JOIN (SELECT page_id, row_number() OVER (ORDER BY updated_at DESC, path) AS i FROM pages_v QUALIFY i <= 41) r) ANTI JOIN have USING (question, page_id))
SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY phase, i) - 1 AS INT) AS place, page_id FROM (SELECT * FROM have UNION ALL SELECT * FROM late) QUALIFY place < 20"""
)
def context_select_batch(spark, d):
    """The context of many sources at once: quotas, neighbours and recent pages as windows by question."""
    pages = V.pages(spark, d).withColumn("scope", F.lit("all"))
    return batch.context_pages(shared.written_index(pages), pages, V.links(spark, d), _questions(pages), 20)


# --- evidence

_HITS = _SCORED + ", hits5 AS (SELECT page_id, path FROM scored ORDER BY matched = 3 DESC, score DESC, path LIMIT 20)"


def _top(spark, d):
    return search.ranked(search.matches(V.pages(spark, d), TERMS), 3, 20)


@_query(_HITS + " SELECT 'wiki' AS kind, path AS reference, page_id FROM hits5 UNION SELECT 'raw', unnest(source_refs), page_id FROM pages_v WHERE page_id IN (SELECT page_id FROM hits5)")
def citations_union(spark, d):
    return evidence.citations(_top(spark, d))


@_query(
    _HITS
    + f", {O.LINKS}, near AS (SELECT DISTINCT page_id AS page, l.* FROM hits5 JOIN links_v l ON l.from_page = page_id OR l.to_page = page_id), kept AS (SELECT DISTINCT from_page, to_page, relation FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY from_page, to_page, relation) AS r FROM near) WHERE r <= 2) SELECT * FROM kept ORDER BY ALL LIMIT 20"
)
def query_links_bounded(spark, d):
    return evidence.hit_links(_top(spark, d), V.links(spark, d), 2, 20)


@_query(
    _SCORED
    + f""", best AS (SELECT page_id, path, title, {O.excerpt('title', 'body', TERMS, 64)} AS snippet FROM (SELECT * FROM scored WHERE scope = 'src3' ORDER BY matched = 3 DESC, score DESC, path LIMIT 5)),
body AS (SELECT CAST(to_json({{'question': 'thing nation ering', 'hits': list({{'page_id': page_id, 'path': path, 'title': title, 'snippet': snippet}} ORDER BY page_id)}}) AS VARCHAR) AS content FROM best)
SELECT 'query' AS adapter, 'result-' || substring(sha256(content), 1, 16) AS source_id, '1' AS version, sha256(content) AS digest, content FROM body"""
)
def query_filed(spark, d):
    return evidence.filed(search.search(V.pages(spark, d), "src3", TERMS, 5, 64), "thing nation ering")


# --- sources and projection


#: Sources that are known already: every third conversation's, some with another digest.
_KNOWN = "known AS (SELECT source_id, version, CASE WHEN CAST(source_id AS BIGINT) % 2 = 0 THEN digest ELSE 'other' END AS digest FROM env WHERE copy = 0 AND CAST(source_id AS BIGINT) % 3 = 0)"


def _known(rows):
    i = F.col("source_id").cast("long")
    return rows.where((F.col("copy") == 0) & (i % 3 == 0)).withColumn("digest", F.when(i % 2 == 0, F.col("digest")).otherwise("other"))


@_query(f"WITH {O.ENVELOPES}, {_KNOWN} SELECT source_id, version, digest FROM env WHERE copy = 0 AND (source_id, version) NOT IN (SELECT (source_id, version) FROM known)")
def source_accept_dedup(spark, d):
    rows = V.envelopes(spark, d)
    return acceptance.accepted(rows, _known(rows), ["received_at", "copy"]).select("source_id", "version", "digest")


@_query(f"WITH {O.ENVELOPES}, {_KNOWN} SELECT b.source_id, b.version, b.digest, coalesce(k.digest, a.digest) AS accepted_digest FROM env a JOIN env b USING (source_id, version) LEFT JOIN known k USING (source_id, version) WHERE a.copy = 0 AND b.digest <> coalesce(k.digest, a.digest)")
def source_conflicts(spark, d):
    rows = V.envelopes(spark, d)
    return acceptance.conflicts(rows, _known(rows), ["received_at", "copy"]).select("source_id", "version", "digest", "accepted_digest")


@_query(f"WITH {O.ENVELOPES} SELECT source_id, version, count(DISTINCT digest) AS digests, count(*) AS n FROM env GROUP BY ALL HAVING count(DISTINCT digest) > 1")
def duplicate_identity(spark, d):
    return V.envelopes(spark, d).groupBy("source_id", "version").agg(F.countDistinct("digest").alias("digests"), F.count(F.lit(1)).alias("n")).where("digests > 1")


@_query(f"WITH {O.PAGES} SELECT scope, count(*) AS page_count, sum(length(body)) AS characters, min(updated_at) AS first_update, max(updated_at) AS last_update FROM pages_v GROUP BY scope")
def projection_counts(spark, d):
    return V.pages(spark, d).groupBy("scope").agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.char_length("body")).alias("characters"), F.min("updated_at").alias("first_update"), F.max("updated_at").alias("last_update"))


@_query(f"WITH {O.PAGES} SELECT scope, sha256(string_agg(p, '' ORDER BY p)) AS rows_digest FROM (SELECT scope, substring(h, 1, 3) || sha256(string_agg(h, '' ORDER BY h)) AS p FROM (SELECT scope, sha256(concat_ws('|', page_id, path, digest, title)) AS h FROM pages_v) GROUP BY scope, substring(h, 1, 3)) GROUP BY scope")
def projection_row_hash(spark, d):
    rows = V.pages(spark, d).select("scope", F.sha2(F.concat_ws("|", "page_id", "path", "digest", "title"), 256).alias("h"))
    return identity.set_hash(rows, ["scope"], "h", "rows_digest")


_LANES = " || ".join(f"lpad(lower(to_hex(CAST(sum(CAST('0x' || substring(h, {1 + identity.LANE * i}, {identity.LANE}) AS UBIGINT)) % {1 << 4 * identity.LANE} AS UBIGINT))), {identity.LANE}, '0')" for i in range(identity.LANES))


@_query(f"WITH {O.PAGES} SELECT scope, {_LANES} AS rows_digest FROM (SELECT scope, sha256(concat_ws('|', page_id, path, digest, title)) AS h FROM pages_v) GROUP BY scope")
def projection_multiset_hash(spark, d):
    rows = V.pages(spark, d).select("scope", F.sha2(F.concat_ws("|", "page_id", "path", "digest", "title"), 256).alias("h"))
    return identity.multiset_hash(rows, ["scope"], "h", "rows_digest")


@_query(f"WITH {O.PAGES}, {O.LINKS} SELECT scope, count(*) AS page_count, 0::BIGINT AS link_count FROM pages_v GROUP BY scope UNION ALL SELECT 'all', 0, count(*) FROM links_v")
def projection_state(spark, d):
    return snapshot_digest(V.pages(spark, d), V.links(spark, d)).select("scope", "page_count", "link_count")


# --- lint


def _lint_page(spark, d):
    i = F.col("doc_id")
    head = (
        F.when(i % 9 == 0, "no frontmatter\n")
        .when(i % 9 == 1, F.concat(F.lit("---\nid: docs/"), i + 1, F.lit("\ntitle: T\ntype: note\nsource_refs: ['docs:"), i, F.lit("@1']\n---\n")))
        .when(i % 9 == 2, F.concat(F.lit("---\nid: docs/"), i, F.lit("\ntype: note\nsource_refs: []\n---\n")))
        .when(i % 9 == 3, "---\ntitle: only\n---\n")
        .otherwise(F.concat(F.lit("---\nid: docs/"), i, F.lit("\ntitle: T\ntype: note\nsource_refs: ['docs:"), i % 50, F.lit("@1']\n---\n")))
    )
    pages = V.linked_pages(spark, d).withColumn("doc_id", F.substring_index("page_id", "/", -1).cast("long")).withColumn("body", F.concat(head, "body"))
    refs = V.table(spark, d, "documents").where("doc_id % 50 < 40").select(F.concat(F.lit("docs:"), F.col("doc_id"), F.lit("@1")).alias("ref"))
    index = pages.where("doc_id % 2 = 0").agg(F.concat(F.lit("# Index\n- [[docs/999999]]\n"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "page_id"))), "\n")).alias("body"))
    return pages, refs, index


def _findings(spark, d):
    pages, refs, index = _lint_page(spark, d)
    return lint.page_findings(pages, lint.parsed(pages), refs).unionByName(lint.link_findings(pages, V.links(spark, d), index))


_LINT = f"""WITH {O.LINKS}, refs AS (SELECT 'docs:' || doc_id || '@1' AS ref FROM documents WHERE doc_id % 50 < 40), p AS (SELECT *, doc_id % 9 AS k FROM bodies),
inc AS (SELECT to_page FROM links_v), found AS (
SELECT 'frontmatter.malformed' AS code, 'error' AS severity, path, page_id FROM p WHERE k = 0
UNION ALL SELECT 'frontmatter.id_mismatch', 'error', path, page_id FROM p WHERE k = 1
UNION ALL SELECT 'frontmatter.title_missing', 'error', path, page_id FROM p WHERE k = 2
UNION ALL SELECT 'frontmatter.id_missing', 'error', path, page_id FROM p WHERE k = 3
UNION ALL SELECT 'frontmatter.type_missing', 'error', path, page_id FROM p WHERE k = 3
UNION ALL SELECT 'citation.missing', 'error', path, page_id FROM p WHERE k IN (2, 3)
UNION ALL SELECT 'citation.unknown_source', 'error', path, page_id FROM p WHERE k = 1 AND 'docs:' || doc_id || '@1' NOT IN (SELECT ref FROM refs) OR k > 3 AND 'docs:' || (doc_id % 50) || '@1' NOT IN (SELECT ref FROM refs)
UNION ALL SELECT 'link.malformed', 'error', path, page_id FROM p WHERE doc_id % 7 = 0
UNION ALL SELECT 'index.broken_page', 'error', 'wiki/index.md', 'docs/999999'
UNION ALL SELECT 'index.broken_page', 'error', 'wiki/index.md', '[[docs/999999]]'
UNION ALL SELECT 'index.missing_page', 'warning', 'wiki/index.md', page_id FROM p WHERE doc_id % 2 = 1
UNION ALL SELECT 'page.orphan', 'warning', path, page_id FROM p WHERE doc_id % 2 = 1 AND page_id NOT IN (SELECT to_page FROM inc)
UNION ALL SELECT 'link.broken', 'error', NULL, from_page FROM links_v WHERE to_page NOT IN (SELECT page_id FROM p)) """


@_query(_LINT + "SELECT * FROM found")
def lint_findings(spark, d):
    return _findings(spark, d).select("code", "severity", "path", "page_id")


@_query(_LINT + "SELECT count(*) = 0 AS healthy, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM found")
def lint_health(spark, d):
    return lint.healthy(_findings(spark, d))


@_query(
    """WITH e AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'gibberish' WHEN 1 THEN '- {"operation_id": "op' || user_id || '", "generation": "g", "schema_digest": "s", "source_refs": [], "files": ["b", "a"]}'
WHEN 2 THEN '- {"operation_id": "op' || event_id || '", "generation": "", "files": ["a"]}' WHEN 3 THEN '# heading' ELSE '- {"operation_id": "op' || event_id || '", "generation": "g", "schema_digest": "other", "files": ["a", "c"]}' END AS line FROM events),
found AS (SELECT 'log.malformed' AS code, 'wiki/log.md' AS path, 'log contains a non-structured entry' AS message FROM e WHERE event_id % 5 = 0
UNION ALL SELECT 'log.malformed', 'wiki/log.md', 'log entry is not a complete structured commit record' FROM e WHERE event_id % 5 = 2
UNION ALL SELECT 'log.duplicate_operation', 'wiki/log.md', 'log contains duplicate operation IDs' FROM (SELECT row_number() OVER (PARTITION BY user_id) AS r FROM e WHERE event_id % 5 = 1) WHERE r > 1
UNION ALL SELECT 'log.schema_mismatch', 'wiki/log.md', 'log entry schema digest differs from the current schema' FROM e WHERE event_id % 5 = 4
UNION ALL SELECT 'log.order', 'wiki/log.md', 'log entry file list is not deterministic' FROM e WHERE event_id % 5 = 1
UNION ALL SELECT 'log.missing_file', 'c', 'log entry cites a file absent from canonical Markdown' FROM e WHERE event_id % 5 = 4)
SELECT code, path, message, count(*) AS n FROM found GROUP BY ALL"""
)
def lint_log_records(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    line = (
        F.when(i % 5 == 0, "gibberish")
        .when(i % 5 == 1, F.concat(F.lit('- {"operation_id": "user'), u, F.lit('", "generation": "g", "schema_digest": "s", "source_refs": [], "files": ["b", "a"]}')))
        .when(i % 5 == 2, F.concat(F.lit('- {"operation_id": "op'), i, F.lit('", "generation": "", "files": ["a"]}')))
        .when(i % 5 == 3, "# heading")
        .otherwise(F.concat(F.lit('- {"operation_id": "op'), i, F.lit('", "generation": "g", "schema_digest": "other", "files": ["a", "c"]}')))
    )
    log = V.table(spark, d, "events").select(i.alias("line_no"), line.alias("line"))
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    return lint.log_findings(log, "s", files).groupBy("code", "path", "message").agg(F.count(F.lit(1)).alias("n"))


# --- operations


@_query(O.STATES + " SELECT * FROM final")
def ops_final_state(spark, d):
    return work.final_states(V.events(spark, d), ["op"], ["ts", "event_id"])


@_query(O.STATES + ", no AS (SELECT o.op, o.i, o.event FROM ordered o JOIN fold f ON f.op = o.op AND f.i = o.i JOIN fold g ON g.op = o.op AND g.i = o.i - 1 WHERE f.n = g.n) SELECT final.op, count(no.i) AS refused, arg_max(no.event, no.i) AS last_refused FROM final LEFT JOIN no ON no.op = final.op GROUP BY final.op")
def ops_refused(spark, d):
    return work.refused_events(V.events(spark, d), ["op"], ["ts", "event_id"])


@_query(f"WITH {O.OPS} SELECT operation_id, CASE status WHEN 'received' THEN 'queued' WHEN 'committed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'running' END AS status, CASE WHEN status = 'failed' THEN 'source' END AS failure_class, generation FROM ops")
def ops_public_status(spark, d):
    return work.public_operations(V.operations(spark, d).withColumn("failure_class", identity.failure_class(F.col("failure"))))


def _now():
    return F.timestamp_seconds(F.lit(1767225600 + 500))


_READY = f"WITH {O.OPS}, seen AS (SELECT *, CASE WHEN work_token = '' THEN work_ready_at ELSE work_expires_at END AS ready_at FROM ops WHERE scope = 'scope-1' AND status NOT IN ('committed', 'failed') AND {O.COMPLETE} AND {O.FREE} ORDER BY ready_at, operation_id LIMIT 100) "


@_query(_READY + f"SELECT operation_id, status, ready_at FROM seen WHERE {O.VALID} ORDER BY ready_at, operation_id LIMIT 16")
def ready_queue(spark, d):
    return work.ready(V.operations(spark, d), "scope-1", _now(), 16).select("operation_id", "status", "ready_at")


@_query(
    _READY
    + f", chosen AS (SELECT operation_id FROM seen WHERE {O.VALID} ORDER BY ready_at, operation_id LIMIT 16) SELECT operation_id, CASE WHEN operation_id IN (SELECT operation_id FROM chosen) THEN 'tok' ELSE work_token END AS work_token, CASE WHEN operation_id IN (SELECT operation_id FROM chosen) THEN {O.NOW} + INTERVAL 30 SECOND ELSE work_expires_at END AS work_expires_at, work_attempt + (operation_id IN (SELECT operation_id FROM chosen))::INT AS work_attempt FROM ops"
)
def claim_ready(spark, d):
    return work.claim(V.operations(spark, d), "scope-1", _now(), "tok", 30, 16).select("operation_id", "work_token", "work_expires_at", "work_attempt")


@_query(f"WITH {O.OPS} SELECT operation_id, created_at FROM ops WHERE scope = 'scope-2' AND status NOT IN ('committed', 'failed') AND NOT ({O.VALID}) ORDER BY created_at, operation_id LIMIT 100")
def descriptor_failures(spark, d):
    return work.descriptor_failures(V.operations(spark, d), "scope-2").select("operation_id", "created_at")


@_query(f"WITH {O.OPS} SELECT scope, count(*) AS free, count(*) FILTER (work_token <> '') AS expired FROM ops WHERE status NOT IN ('committed', 'failed') AND {O.FREE} GROUP BY scope")
def lease_expired(spark, d):
    ops = V.operations(spark, d).where(~F.col("status").isin("committed", "failed") & work.free(_now()))
    return ops.groupBy("scope").agg(F.count(F.lit(1)).alias("free"), F.count(F.when(F.col("work_token") != "", 1)).alias("expired"))


@_query(
    "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'new' WHEN turn % 2 = 1 THEN 'replay' ELSE 'conflict' END AS outcome FROM conversations"
)
def reserve_outcomes(spark, d):
    rows = V.table(spark, d, "conversations")
    key = [F.lit("s").alias("scope"), F.lit("chat").alias("adapter"), F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("string").alias("version")]
    found = identity.digest(F.col("text").cast("binary"))
    known = rows.where("turn > 0").select(*key, F.when(F.col("turn") % 2 == 1, found).otherwise("x").alias("digest"), F.lit("op").alias("operation_id"))
    return work.reservations(rows.select("conv_id", "turn", *key, found.alias("digest")), known).select("conv_id", "turn", "outcome")


# --- edit plans


_PLANS = """SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'schema_mismatch' WHEN doc_id % 10 = 2 THEN 'source_refs' WHEN doc_id % 10 = 3 THEN 'source_not_cited' WHEN doc_id % 10 IN (4, 5, 6) THEN 'forbidden_path' WHEN doc_id % 10 = 7 THEN 'duplicate_path' WHEN doc_id % 10 = 8 THEN 'too_many_files' WHEN doc_id % 10 = 9 THEN 'file_too_large' END AS failure FROM documents"""


@_query(_PLANS.replace("doc_id,", "doc_id AS plan_id,", 1))
def plan_validation(spark, d):
    i = F.col("doc_id")
    k = i % 10
    edit = lambda p, c: F.struct(p.alias("path"), c.alias("content"))
    good = F.concat(F.lit("wiki/p"), i, F.lit(".md"))
    path = F.when(k == 4, "wiki/log.md").when(k == 5, "wiki/../x.md").when(k == 6, "raw/x.md").otherwise(good)
    content = F.when(k == 9, F.repeat(F.lit("x"), (256 << 10) + 1)).otherwise("text")
    base = F.array(edit(path, content), edit(F.when(k == 7, good).otherwise(F.lit("wiki/z.md")), F.lit("")))
    many = F.transform(F.sequence(F.lit(1), F.lit(33)), lambda n: edit(F.concat(F.lit("wiki/q"), n, F.lit(".md")), F.lit("")))
    ref = F.concat(F.lit("docs:"), i, F.lit("@1"))
    plans = V.table(spark, d, "documents").select(
        i.alias("plan_id"), F.when(k == 1, "other").otherwise("s").alias("plan_schema"), F.lit("s").alias("schema_digest"), ref.alias("wanted_ref"),
        F.when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("docs:none@1"))).otherwise(F.array(F.lit("a:b@1"), ref)).alias("source_refs"), F.lit("why").alias("rationale"), F.when(k == 8, many).otherwise(base).alias("edits"),
    )
    return edits.validated(plans).select("plan_id", "failure")


@_query("SELECT conv_id AS run, CASE WHEN max(length(text)) = 0 THEN 'empty' WHEN count(*) FILTER (turn % 3 = 1) = 0 THEN 'malformed' END AS failure, sha256(arg_max(text, turn) FILTER (turn % 3 = 1)) AS content FROM conversations GROUP BY conv_id")
def plan_decoding(spark, d):
    """Turns as output lines: plain text, plans that hold the turn's text, plans with something behind them."""
    t, text_ = F.col("turn") % 3, F.col("text")
    plan = F.to_json(F.struct(F.lit("s").alias("schema_digest"), F.array(F.lit("a:b@1")).alias("source_refs"), F.lit(1).alias("unknown"), F.array(F.struct(F.lit("wiki/a.md").alias("path"), F.lit("").alias("expected_digest"), text_.alias("content"))).alias("edits")))
    rows = V.table(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("line_no"), F.when(t == 1, plan).when(t == 2, F.concat(plan, F.lit(" and more"))).otherwise(text_).alias("line"))
    return edits.decoded_plans(rows).select("run", "failure", F.sha2(F.col("plan.edits")[0]["content"].cast("binary"), 256).alias("content"))


@_query("SELECT doc_id, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'create' WHEN doc_id % 2 = 1 THEN 'unexpected_precondition' WHEN doc_id % 3 = 0 THEN 'missing_precondition' WHEN doc_id % 3 = 1 THEN 'ok' ELSE 'stale' END AS outcome FROM documents")
def edit_preconditions(spark, d):
    i, found = F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)
    docs = V.table(spark, d, "documents").select(i, F.concat(F.lit("wiki/"), i, F.lit(".md")).alias("path"), found.alias("digest"))
    given = docs.select("doc_id", "path", F.when(i % 3 == 1, F.upper("digest")).when(i % 3 == 2, F.repeat(F.lit("0"), 64)).otherwise("").alias("expected_digest"))
    return edits.preconditions(given, docs.where("doc_id % 2 = 0")).select("doc_id", "outcome")


@_query(f"WITH {O.LINKS} SELECT from_page AS page_id, to_page AS target FROM links_v WHERE to_page NOT IN (SELECT page_id FROM bodies) AND CAST(split_part(from_page, '/', 2) AS INT) % 2 = 0")
def prospective_links(spark, d):
    pages = V.linked_pages(spark, d)
    even = F.substring_index("page_id", "/", -1).cast("int") % 2 == 0
    return edits.prospective_broken(pages.where(even).select("path", F.col("body").alias("content")), pages.where(~even))


# --- import of trees


_REFS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'dir' || (doc_id % 5) || '/n' || doc_id WHEN 1 THEN 'n' || doc_id WHEN 2 THEN 'same' WHEN 3 THEN 'img/a' || doc_id || '.png' WHEN 4 THEN 'a' || (doc_id - 1) || '.png' ELSE 'nowhere' END AS target FROM documents"


@_query(
    f"WITH refs AS ({_REFS}) SELECT doc_id, target, CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS kind, CASE doc_id % 6 WHEN 0 THEN 'notes/dir' || (doc_id % 5) || '/n' || doc_id WHEN 1 THEN 'notes/dir' || (doc_id % 5) || '/n' || doc_id WHEN 3 THEN 'wiki/assets/img/a' || doc_id || '.png' WHEN 4 THEN 'wiki/assets/img/a' || (doc_id - 1) || '.png' END AS value FROM refs"
)
def obsidian_rewrite_targets(spark, d):
    i = F.col("doc_id")
    docs = V.table(spark, d, "documents").select("doc_id")
    notes = docs.select(F.concat(F.lit("dir"), i % 5, F.lit("/n"), i, F.lit(".md")).alias("path")).unionByName(docs.where("doc_id < 2").select(F.concat(F.lit("s"), i, F.lit("/same.md")).alias("path")))
    files = notes.unionByName(docs.select(F.concat(F.lit("img/a"), i, F.lit(".png")).alias("path"))).unionByName(docs.select(F.concat(F.lit(".obsidian/n"), i, F.lit(".md")).alias("path")))
    refs = spark.sql(_REFS.replace("FROM documents", "FROM {docs}"), docs=docs)
    return bootstrap.resolved(refs, bootstrap.catalog(bootstrap.inputs(files))).select("doc_id", "target", "kind", "value")


@_query(f"WITH {O.PAGES} SELECT sha256('# Index' || chr(10) || chr(10) || string_agg('- [[' || page_id || '|' || title || ']]', chr(10) ORDER BY path) || chr(10)) AS digest, count(*) AS n FROM pages_v")
def render_index(spark, d):
    pages = V.pages(spark, d)
    return bootstrap.rendered_index(pages).select(F.sha2("body", 256).alias("digest")).crossJoin(pages.agg(F.count(F.lit(1)).alias("n")))


@_query(f"WITH {O.PAGES} SELECT CAST(row_number() OVER (ORDER BY path, page_id) AS BIGINT) AS line_no, '- [[' || page_id || '|' || title || ']]' AS line FROM pages_v")
def render_index_lines(spark, d):
    """The index as numbered lines by range, where no task holds all of it."""
    rows = V.pages(spark, d).select("path", "page_id", F.concat(F.lit("- [["), "page_id", F.lit("|"), "title", F.lit("]]")).alias("line"))
    return text.numbered(rows, ["path", "page_id"], shared.folder(spark, "index-lines")).select("line_no", "line")


@_query(
    """SELECT 'n' || doc_id || '.md' AS path, 'See ' || CASE WHEN doc_id + 1 IN (SELECT doc_id FROM documents) THEN '[[notes/n' ELSE '[[n' END || (doc_id + 1) || '#Part|other]] and '
|| CASE WHEN doc_id % 7 IN (SELECT doc_id FROM documents WHERE doc_id < 5) THEN '![](../assets/a' ELSE '![unsupported obsidian embed](a' END || (doc_id % 7) || '.png) and [[lost]] [[open' AS body FROM documents"""
)
def obsidian_rewrite(spark, d):
    i = F.col("doc_id")
    docs = V.table(spark, d, "documents").select("doc_id")
    notes = docs.select(F.concat(F.lit("n"), i, F.lit(".md")).alias("path"), F.concat(F.lit("See [[n"), i + 1, F.lit("#Part|other]] and ![[a"), i % 7, F.lit(".png]] and [[lost]] [[open")).alias("body"))
    files = notes.select("path").unionByName(docs.where("doc_id < 5").select(F.concat(F.lit("a"), i, F.lit(".png")).alias("path")))
    return bootstrap.rewritten(notes, bootstrap.catalog(bootstrap.inputs(files)))


# --- streams


@_query(f"WITH {O.ENVELOPES} SELECT source_id, version, digest FROM env WHERE copy = 0")
def stream_accept_available_now(spark, d):
    from loamstack.plans.streams import accepted_once

    return accepted_once(spark, d)


@_query(O.STATES + " SELECT * FROM final")
def stream_ops_state(spark, d):
    from loamstack.plans.streams import states_once

    return states_once(spark, d)


