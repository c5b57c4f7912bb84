"""Tokens, query terms and excerpts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstack.model import FRAMING_WORDS, MAX_TERM_RUNES, MAX_TERMS, OMISSION, InvalidQuery

#: A token starts at a letter or number and goes on through letters, numbers and combining marks.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct tokens without framing words, in first-seen order."""
    return F.filter(F.array_distinct(tokens(text)), lambda x: ~x.isin(*FRAMING_WORDS))


def runes(terms: Column) -> Column:
    """Characters of all terms together."""
    return F.aggregate(terms, F.lit(0), lambda n, x: n + F.char_length(x))


def valid_query(terms: Column) -> Column:
    """Whether terms are within a query's bounds."""
    return F.size(terms).between(1, MAX_TERMS) & (runes(terms) <= MAX_TERM_RUNES)


def summary_terms(*parts: Column) -> Column:
    """Terms of accepted parts, cut at the first that passes a bound; a term that is too long alone is left out."""
    every = F.array_distinct(F.flatten(F.array(*[content_terms(p) for p in parts])))
    return let(F.filter(every, lambda x: F.char_length(x) <= MAX_TERM_RUNES), _bounded)


def _bounded(fit: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("runes"))
    count = F.aggregate(
        fit,
        start,
        lambda a, x: F.when((a["n"] >= 0) & (a["n"] < MAX_TERMS) & (a["runes"] + F.char_length(x) <= MAX_TERM_RUNES), F.struct((a["n"] + 1).alias("n"), (a["runes"] + F.char_length(x)).alias("runes"))).otherwise(
            F.struct(F.when(a["n"] >= 0, -a["n"] - 1).otherwise(a["n"]).alias("n"), a["runes"].alias("runes"))
        ),
        lambda a: F.when(a["n"] >= 0, a["n"]).otherwise(-a["n"] - 1),
    )
    return F.slice(fit, F.lit(1), count)


def query_terms(raw: str) -> list[str]:
    """The terms of one query text, on the driver; raises InvalidQuery beyond the bounds."""
    import regex

    found = [t for t in dict.fromkeys(regex.findall(TOKEN, raw.lower())) if t not in FRAMING_WORDS]
    if not found or len(found) > MAX_TERMS or sum(map(len, found)) > MAX_TERM_RUNES:
        raise InvalidQuery(f"{len(found)} terms")
    return found


def term_pattern(terms: list[str]) -> str:
    """An expression that matches the first complete token among the terms, after everything before it."""
    inside = r"[\p{L}\p{N}]"
    either = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) or r"\z."
    # the letters are looked for first: what stands before them is checked only there
    return rf"(?s)^(.*?)(?={either})(?<!{inside})(?<!{inside}\p{{M}}{{1,16}})({either})(?![\p{{L}}\p{{N}}\p{{M}}])"


def contains_term(text: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(tokens(text), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def excerpt(title: Column, body: Column, terms: list[str], limit: int) -> Column:
    """A fragment of title and body of at most ``limit`` characters around the first term.

    The context is shared between both sides of the match, what one side can't use goes to the other, and
    an ellipsis stands for what is left out where there is room for it.
    """
    if limit <= 0:
        return body
    whole = trimmed(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))
    pattern = term_pattern(terms)

    def placed(w: Column) -> Column:
        low = F.lower(w)
        return F.struct(w.alias("w"), F.char_length(w).alias("n"), F.char_length(F.regexp_extract(low, pattern, 1)).alias("at"), F.char_length(F.regexp_extract(low, pattern, 2)).alias("size"))

    return let(whole, lambda w: F.when(F.char_length(w) <= limit, w).otherwise(let(placed(w), lambda p: _window(p, limit))))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _window(p: Column, limit: int) -> Column:
    text, n, at, size = p["w"], p["n"], p["at"], p["size"]
    end, room = at + size, F.lit(limit) - size
    left, right = at > 0, end < n
    both, one = (room >= 2) & left & right, (room >= 1) & left & right
    lead = F.when(both, True).when(one, at >= n - end).otherwise((room >= 1) & left)
    trail = F.when(both, True).when(one, at < n - end).otherwise((room >= 1) & right & ~left)
    marks = F.struct(lead.alias("lead"), trail.alias("trail"), (room - lead.cast("int") - trail.cast("int")).alias("context"))

    def sides(m: Column) -> Column:
        first = F.least(F.floor(m["context"] / 2).cast("int"), at)
        after = F.least(m["context"] - first, n - end)
        return F.struct(m["lead"].alias("lead"), m["trail"].alias("trail"), after.alias("after"), (first + F.least(F.greatest(m["context"] - first - after, F.lit(0)), at - first)).alias("before"))

    def cut(s: Column) -> Column:
        before, after = s["before"], s["after"]
        lead_mark = F.when(s["lead"] & (at - before > 0), OMISSION).otherwise("")
        trail_mark = F.when(s["trail"] & (end + after < n), OMISSION).otherwise("")
        return F.concat(lead_mark, F.substring(text, at - before + 1, before + size + after), trail_mark)

    around = let(marks, lambda m: let(sides(m), cut))
    prefix = F.lit(OMISSION) if limit == 1 else F.concat(F.substring(text, F.lit(1), F.lit(limit - 1)), F.lit(OMISSION))
    return F.when(size == 0, prefix).when(size >= limit, F.substring(text, at + 1, F.lit(limit))).otherwise(around)
