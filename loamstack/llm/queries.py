"""Registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loamstack.llm.bpe_transducer import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.decontaminate import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.ppm_langid import languages

    return languages(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.cotrain import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.brown_lm import held_out_scores

    return held_out_scores(_read(spark, sf_dir, "documents"))


#: Capture day of a page, and the dated list of the query: entries for about two thirds of the hosts seen, by digits of their MD5, and three wider ones.
_CAPTURES = "SELECT page_id, url, {day}(DATE '2024-01-01', CAST((page_id * 37) % 366 AS INT)) AS fetched_on FROM pages"
_HOSTS = "SELECT DISTINCT regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:@]*)', 1) AS h FROM pages WHERE url IS NOT NULL"
_ENTRIES = """
SELECT list_name, pattern, action, {day}(DATE '2024-01-01', CAST(d AS INT)) AS effective_on FROM (
  SELECT CASE WHEN v % 3 = 0 THEN 'ads' ELSE 'spam' END AS list_name, h AS pattern, 'add' AS action, v % 180 AS d FROM v WHERE v % 3 < 2
  UNION ALL SELECT CASE WHEN v % 3 = 0 THEN 'ads' ELSE 'spam' END, h, 'remove', v % 180 + 60 + v % 50 FROM v WHERE v % 3 < 2 AND v % 2 = 0
  UNION ALL SELECT CASE WHEN v % 3 = 0 THEN 'ads' ELSE 'spam' END, h, 'add', v % 180 + 150 FROM v WHERE v % 3 < 2 AND v % 4 = 0
  UNION ALL SELECT 'locale', h || '/fr/', 'add', v % 90 FROM v WHERE v % 5 = 0
  UNION ALL SELECT 'wide', 'example.org', 'add', 300
  UNION ALL SELECT 'wide', 'Example.ORG', 'remove', 330
  UNION ALL SELECT 'wide', 'ads-track.example.com', 'add', 100
) e"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.url_filter import judge

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    pages.createOrReplaceTempView("op4_pages")
    sql = lambda text: spark.sql(text.replace("FROM pages", "FROM op4_pages").format(day="date_add"))
    sql(f"SELECT h, CAST(conv(substring(md5(h), 1, 4), 16, 10) AS INT) AS v FROM ({_HOSTS})").createOrReplaceTempView("op4_hosts")
    entries = sql(_ENTRIES.replace("FROM v ", "FROM op4_hosts "))
    return judge(sql(_CAPTURES), entries).select("page_id", "host", "fetched_on", "n_active", "lists", "since", "blocked")


_OP4_ORACLE = (
    "WITH v AS (SELECT h, CAST('0x' || substring(md5(h), 1, 4) AS INT) AS v FROM (" + _HOSTS + ")), entries AS (" + _ENTRIES.replace("{day}(DATE '2024-01-01', CAST(d AS INT))", "CAST(DATE '2024-01-01' + CAST(d AS INT) AS DATE)") + "), "
    "captures AS (" + _CAPTURES.replace("{day}(DATE '2024-01-01', CAST((page_id * 37) % 366 AS INT))", "CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INT) AS DATE)") + "), "
    """hosts AS (SELECT *, rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS host,
      regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM captures),
    known AS (SELECT DISTINCT list_name, lower(split_part(pattern, '/', 1)) AS domain,
      CASE WHEN contains(pattern, '/') THEN substring(pattern, strpos(pattern, '/')) ELSE '' END AS prefix, action, effective_on FROM entries),
    spans AS (SELECT list_name, domain, prefix, action, effective_on AS valid_from,
      lead(effective_on) OVER (PARTITION BY list_name, domain, prefix ORDER BY effective_on, action) AS valid_to FROM known),
    hits AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists, max(valid_from) AS since
      FROM hosts JOIN spans ON action = 'add' AND valid_from <= fetched_on AND (valid_to IS NULL OR valid_to > fetched_on)
      AND (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id)
    SELECT hosts.page_id, coalesce(host, '') AS host, fetched_on, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, since, n IS NOT NULL AS blocked
    FROM hosts LEFT JOIN hits USING (page_id)"""
)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.chat_transcripts import recovered_turns

    return recovered_turns(_read(spark, sf_dir, "conversations"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.filter_audit import filter_audit

    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loamstack.llm.divergence import quality_rules

    return quality_rules(_read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loamstack.llm.token_alignment import alignment

    return alignment(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


_OP7_ORACLE = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP2_ORACLE = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), it AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM it WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS g FROM (SELECT *, unnest(range(len(ws) - n + 1)) AS i FROM sized)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS i FROM w CROSS JOIN (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


_CLASSES = {"lower": "[a-z]", "space": r"[\x20\x09-\x0D]", "letters": r"[^\x00-\x7F\P{L}]", "upper": "[A-Z]", "digits": "[0-9]", "stops": r"[.,;:!?''\"()\-]", "symbols": "[#*$%&|<>]"}
_HALF = "(CASE WHEN {p} > 0 THEN {p} / 2 * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} / 2 * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"
_CHANCE = "least({q} / 2, 1 / (8 * {n} * 0.6931471805599453))"
_BINS = [*_CLASSES, "other"]
_OP12_ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, CAST(length(t) AS DOUBLE) AS chars, {", ".join(f"length(t) - length(regexp_replace(t, '{x}', '', 'g')) AS c_{k}" for k, x in _CLASSES.items())} FROM d),
m AS (SELECT r, doc_id, l, CAST(len(ws) AS BIGINT) AS n_words, chars, length(t) - c_space AS word_chars, c_symbols AS n_symbols, {", ".join(f"c_{k}" for k in _CLASSES)}, chars - {" - ".join(f"c_{k}" for k in _CLASSES)} AS c_other,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM (SELECT r, i, array_to_string(list_slice(ws, i + 1, i + 5), ' ') AS s FROM (SELECT r, ws, unnest(range(len(ws) - 4)) AS i FROM w WHERE len(ws) > 5))),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE k > 1) GROUP BY r),
u AS (SELECT r, l, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS word FROM d),
n AS (SELECT l, word, count(*) AS n FROM u GROUP BY ALL), tot AS (SELECT l, sum(n) AS total FROM n GROUP BY l),
common AS (SELECT l, word, n / total AS q, total FROM n JOIN tot USING (l) WHERE n * 1000 >= total),
refs AS (SELECT l, {", ".join(f"sum(c_{k}) / greatest(sum(chars), 1) AS q_{k}" for k in _BINS)} FROM m GROUP BY l),
shares AS (SELECT l, sum(q) AS share, list(q) AS qs, max(total) AS total FROM common GROUP BY l),
hits AS (SELECT r, word, count(*) AS n FROM u JOIN common USING (l, word) GROUP BY ALL),
held AS (SELECT r, sum({_HALF.format(p="p", q="q")} - q / 2) AS parts, sum(n) AS n_common FROM (SELECT r, n, n / n_words AS p, q FROM hits JOIN m USING (r) JOIN common USING (l, word)) GROUP BY r),
j AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, total, n_words >= 50 AND total >= 10000 AS by_word, chars >= 200 AND total >= 10000 AS by_class, qs, greatest(1 - share, 0) AS rare, share,
  1 - coalesce(n_common, 0) / n_words AS mine, coalesce(parts, 0) AS parts, {" + ".join(_HALF.format(p=f"(c_{k} / chars)", q=f"q_{k}") for k in _BINS)} AS cd, {" + ".join(_CHANCE.format(q=f"q_{k}", n="chars") for k in _BINS)} AS cc
  FROM m LEFT JOIN rep USING (r) LEFT JOIN held USING (r) LEFT JOIN refs USING (l) LEFT JOIN shares USING (l)),
v AS (SELECT *, parts + share / 2 + {_HALF.format(p="mine", q="rare")} AS wd, {_CHANCE.format(q="rare", n="n_words")} + list_sum(list_transform(qs, lambda q: {_CHANCE.format(q="q", n="n_words")})) AS wc,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT coalesce(by_word AND wd > wc + 0.15, false) AND NOT coalesce(by_class AND cd > cc + 0.1, false) AS kept,
CASE WHEN by_class THEN round(sqrt(greatest(cd, 0)), 6) END AS class_distance, CASE WHEN by_word THEN round(sqrt(greatest(wd, 0)), 6) END AS word_distance FROM v"""


_OP11_ORACLE = r"""WITH RECURSIVE x AS (SELECT *, coalesce(text, '') AS t, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
  100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM x LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: (y = 'A' AND a) OR (y = 'B' AND b) OR (y = 'C' AND c) OR (y = 'D' AND d) OR (y = 'E' AND e)) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
p AS (SELECT [y] AS o FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(y) UNION ALL SELECT list_append(o, y) FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(y) WHERE NOT list_contains(o, y)),
s AS (SELECT array_to_string(o, '') AS filter_order, CAST(i AS INT) AS step, o[i] AS letter, list_slice(o, 1, i - 1) AS before FROM (SELECT o, unnest(range(1, 6)) AS i FROM p WHERE len(o) = 5)),
r AS (SELECT part, filter_order, step, letter, list_contains(fails, letter) AS hit, list_has_any(fails, before) AS gone, fails = [letter] AS alone, n, good, toxic FROM m CROSS JOIN s),
g AS (SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_lm": op1_brown_lm,
        "op2_decontamination": op2_decontamination,
        "op3_simhash": op3_simhash,
        "op4_url_filter": op4_url_filter,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_chat": op10_chat,
        "op11_filter_audit": op11_filter_audit,
        "op12_divergence": op12_divergence,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2_ORACLE, "op4_url_filter": _OP4_ORACLE, "op7_exact_dedup": _OP7_ORACLE, "op11_filter_audit": _OP11_ORACLE, "op12_divergence": _OP12_ORACLE}
