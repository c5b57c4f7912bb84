"""Inverted index and two-phase ranked search.

Ranking is BM25 with the title weighted 8 to 1; N, document frequencies and the mean
length cover the whole table, all scopes together. A page that holds all terms
ranks before one that holds some, so the strict phase is a prefix of the result
and one ordered limit gives both phases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.functions.lexical import content_terms, excerpt, query_terms, tokens
from loamstack.model import page_limit, require_scope

TITLE_WEIGHT, K1, B = 8.0, 1.2, 0.75


def doc_lengths(pages: DataFrame) -> DataFrame:
    """scope, page_id, dl: tokens of title and body."""
    return pages.select("scope", "page_id", (F.size(tokens(F.col("title"))) + F.size(tokens(F.col("body")))).cast("long").alias("dl"))


def frequencies(marked, n_title):
    """Distinct words, and for each that a text holds: its place among them, the text's, how often title and body hold it.

    ``marked``: lists of tokens (Arrow), those of the title first; ``n_title``: how many these are.
    """
    import numpy as np
    import pyarrow.compute as pc

    n, lengths = len(marked), pc.list_value_length(marked).to_numpy(zero_copy_only=False).astype("i8")
    words = marked.flatten().dictionary_encode()
    text = np.repeat(np.arange(n), lengths)
    place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    titled = place < np.repeat(n_title, lengths)
    keys, times = np.unique((words.indices.to_numpy().astype("i8") * n + text) * 2 + titled, return_counts=True)
    if not len(keys):
        none = np.zeros(0, "i8")
        return words.dictionary, none, none, none, none
    first = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
    term, at = np.divmod(keys[first] >> 1, n)
    return words.dictionary, term, at, *(np.add.reduceat(np.where(keys & 1 == k, times, 0), first) for k in (1, 0))


#: Rows whose tokens are counted at once.
COUNTED_ROWS = 1000


def _postings(pages: DataFrame) -> DataFrame:
    """Postings of each row by itself, counted where the row is read."""
    title, body = tokens(F.col("title")), tokens(F.col("body"))
    rows = pages.select("scope", "page_id", F.size(title).alias("n_title"), F.concat(title, body).alias("marked"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(i, COUNTED_ROWS)
                words, term, at, *counts = frequencies(part.column("marked"), part.column("n_title").to_numpy())
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column("scope").take(at), part.column("page_id").take(at), words.take(pa.array(term)), *map(pa.array, counts)], names=["scope", "page_id", "term", "tf_title", "tf_body"])

    kind = lambda name: pages.schema[name].dataType.simpleString()
    return rows.mapInArrow(run, f"scope {kind('scope')}, page_id {kind('page_id')}, term string, tf_title long, tf_body long")


def postings(pages: DataFrame) -> DataFrame:
    """scope, page_id, term, tf_title, tf_body. Rows are counted where they are read, with no shuffle; only the postings of rows that share a page id are summed.

    A job over the ids alone tells at once whether there are such rows.
    """
    again = pages.groupBy(F.col("scope").alias("_scope"), F.col("page_id").alias("_page_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if again.isEmpty():
        return _postings(pages)
    shared = F.col("scope").eqNullSafe(F.col("_scope")) & F.col("page_id").eqNullSafe(F.col("_page_id"))
    several = _postings(pages.join(again, shared, "left_semi"))
    summed = several.groupBy("scope", "page_id", "term").agg(F.sum("tf_title").alias("tf_title"), F.sum("tf_body").alias("tf_body"))
    return _postings(pages.join(again, shared, "left_anti")).unionByName(summed)


def _saturated(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * dl / F.lit(mean)))


def _idf(n: int, df: int) -> float:
    import math

    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def matches(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Pages that hold a term: their columns, matched (number of terms held) and score.

    Two scans and no shuffle of text: the first reduces to a handful of numbers (pages, mean length, document
    frequencies), the second scores every page within one projection.
    """
    def numbers(t: Column, b: Column) -> Column:
        count = lambda field, term: F.size(F.filter(field, lambda x: x == term))
        return F.struct((F.size(t) + F.size(b)).cast("double").alias("_dl"), *[(count(t, x) * TITLE_WEIGHT + count(b, x)).alias(f"_f{i}") for i, x in enumerate(terms)])

    # a generator of one row: no filter passes it, so that a text is cut into tokens once
    pair = F.array(F.struct(tokens(F.col("title")).alias("t"), tokens(F.col("body")).alias("b")))
    wide = pages.select(*pages.columns, F.inline(F.transform(pair, lambda p: numbers(p["t"], p["b"]))))
    n, mean, *dfs = wide.agg(F.count(F.lit(1)), F.coalesce(F.avg("_dl"), F.lit(0.0)), *[F.sum((F.col(f"_f{i}") > 0).cast("long")) for i in range(len(terms))]).first()
    held, score = F.lit(0), F.lit(0.0)
    likely = F.lit(False)
    for term in terms:
        likely = likely | F.lower("title").contains(term) | F.lower("body").contains(term)
    wide = pages.where(likely).select(*pages.columns, F.inline(F.transform(pair, lambda p: numbers(p["t"], p["b"]))))
    for i, df in enumerate(dfs):
        f = F.col(f"_f{i}")
        held = held + (f > 0).cast("int")
        score = score + F.when(f > 0, _saturated(f, F.col("_dl"), mean or 1.0) * _idf(n, df or 0)).otherwise(F.lit(0.0))
    return wide.select(*pages.columns, held.alias("matched"), F.round(score, 6).alias("score")).where("matched > 0")


def indexed_matches(index: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """scope, page_id, matched, score from written postings and lengths; the term filter reaches the scan of the index."""
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    hits = index.where(F.col("term").isin(*terms)).withColumn("tf", F.col("tf_title") * TITLE_WEIGHT + F.col("tf_body"))
    dfs = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not dfs:
        return lengths.limit(0).select("scope", "page_id", F.lit(0).alias("matched"), F.lit(0.0).alias("score"))
    idf = F.lit(0.0)
    for term, df in dfs.items():
        idf = F.when(F.col("term") == term, F.lit(_idf(n, df))).otherwise(idf)
    scored = hits.join(lengths, ["scope", "page_id"]).withColumn("s", idf * _saturated(F.col("tf"), F.col("dl").cast("double"), mean))
    return scored.groupBy("scope", "page_id").agg(F.count(F.lit(1)).cast("int").alias("matched"), F.round(F.sum("s"), 6).alias("score"))


def ranked(found: DataFrame, n_terms: int, limit: int) -> DataFrame:
    """All terms first, then by score, then by path and id."""
    return found.withColumn("strict", F.col("matched") == n_terms).orderBy(F.desc("strict"), F.desc("score"), "path", "page_id").limit(limit)


def search(pages: DataFrame, scope: str, query: str | list[str], limit: int = 0, characters: int = 0) -> DataFrame:
    """page_id, path, title, snippet, source_refs, untrusted, score, strict of the best pages of a scope.

    ``characters``: length of the snippet; 0 gives the whole body. A query without a term, or beyond the bounds, raises InvalidQuery.
    """
    require_scope(scope)
    terms = query_terms(query) if isinstance(query, str) else query
    top = ranked(matches(pages, terms).where(F.col("scope") == scope), len(terms), page_limit(limit))
    snippet = excerpt(F.col("title"), F.col("body"), terms, characters)
    return top.select("page_id", "path", "title", snippet.alias("snippet"), "source_refs", F.lit(True).alias("untrusted"), "score", "strict")


def strict_matches(pages: DataFrame, terms: list[str]) -> DataFrame:
    return matches(pages, terms).where(F.col("matched") == len(terms))


def related_terms(title: Column, adapter: Column, source_id: Column) -> Column:
    """Terms that a source is looked up by: title, then id, then adapter."""
    from loamstack.functions.lexical import summary_terms

    return summary_terms(title, source_id, adapter)


__all__ = ["content_terms", "doc_lengths", "frequencies", "indexed_matches", "matches", "postings", "ranked", "related_terms", "search", "strict_matches"]
