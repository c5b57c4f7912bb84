"""Markdown pages: titles, frontmatter, wiki links, page ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstack.functions.lexical import let, trimmed
from loamstack.model import TITLE_RUNES, struct

_LINK = r"(?s)\[\[(.*?)\]\]"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _first(items: Column) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))


def source_title(text: Column) -> Column:
    """The first ATX heading, else the first line that is not blank; 256 characters at most."""
    # lines without a character that is not white space never count; only headings and the first line are trimmed
    heads = F.filter(F.transform(F.filter(lines(text), lambda x: x.contains("#")), lambda x: F.regexp_extract(trimmed(x), r"^#{1,6}[ \t]\s*(.*)$", 1)), lambda x: x != "")
    first = trimmed(F.regexp_extract(F.coalesce(text, F.lit("")), r"\A\s*(\S[^\n]*)", 1))
    return let(heads, lambda h: F.substring(F.when(F.size(h) > 0, _first(h)).otherwise(first), 1, TITLE_RUNES))


def page_title(text: Column) -> Column:
    """The first line that starts with '# '."""
    heads = F.filter(F.transform(lines(text), trimmed), lambda x: x.startswith("# "))
    return trimmed(F.substring(_first(heads), F.lit(3), F.lit(1 << 30)))


def normal_target(target: Column) -> Column:
    """A wiki reference as a page id; '' if it isn't one."""
    name = F.regexp_replace(trimmed(F.regexp_replace(target, "^wiki/", "")), r"\.md$", "")
    wrong = (name == "") | (name == ".") | name.startswith("/") | name.startswith("../") | name.contains("/../")
    return F.when(wrong, "").otherwise(name)


def targets(text: Column) -> Column:
    """Page ids of the wiki links, repeats included."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LINK), F.lit(1))
    return F.filter(F.transform(raw, lambda x: normal_target(F.regexp_extract(trimmed(x), r"(?s)^([^|#]*)", 1))), lambda x: x != "")


def unclosed(text: Column) -> Column:
    """Whether a link is opened and not closed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LINK, " ").contains("[[")


def index_targets(text: Column) -> Column:
    """Targets of an index page: its links, and every list item taken as a bare target."""
    items = F.filter(F.transform(lines(text), trimmed), lambda x: x.startswith("- "))
    bare = F.transform(items, lambda x: normal_target(trimmed(F.substring(x, F.lit(3), F.lit(1 << 30)))))
    return F.concat(targets(text), F.filter(bare, lambda x: x != ""))


def page_id(path: Column) -> Column:
    """The page id of a wiki path; null for index, log and anything that is no page."""
    clean = F.regexp_replace(trimmed(path), r"\\", "/")
    name = F.regexp_extract(clean, r"(?s)^wiki/(.*)\.md$", 1)
    return F.when((name != "") & ~clean.isin("wiki/index.md", "wiki/log.md") & (normal_target(name) == name), name)


def safe_edit_path(path: Column) -> Column:
    """Whether an edit may write this path: Markdown below wiki/, not the log, no way out."""
    clean = trimmed(F.coalesce(path, F.lit("")))
    return clean.rlike(r"^wiki/[^\\]+\.md$") & (clean != "wiki/log.md") & ~clean.rlike(r"(^|/)\.{1,2}(/|$)|//")


def wiki_links(pages):
    """scope, from_page, to_page, relation: the distinct links of pages (scope, page_id, body)."""
    return pages.select("scope", F.col("page_id").alias("from_page"), F.explode(F.array_distinct(targets(F.col("body")))).alias("to_page"), F.lit("wiki").alias("relation"))


FRONTMATTER = struct("ok boolean, id string, title string, type string, source_refs array<string>, extras string")


#: A first line, and all up to a line of three dashes.
_LEADING = r"(?s)\A[^\n]*+\n(?:.*?\n)?[ \t\r]*+---[ \t\r]*+(?:\n|\z)"


def leading(text: Column) -> Column:
    """What of a text can be its frontmatter: all up to the second line of dashes; nothing where the first line has none, the whole where no line ends it."""
    text = F.coalesce(text, F.lit(""))
    opened = F.substring_index(text, "\n", 1).contains("---")
    return F.when(opened, let(F.regexp_extract(text, _LEADING, 0), lambda x: F.when(x == "", text).otherwise(x))).otherwise("")


def frontmatter(text: Column) -> Column:
    """The YAML block that leads a page; ``ok`` is false if it is missing or malformed. Extras are JSON. Of a text only the block goes to Python."""
    return _frontmatter(leading(text))


@F.pandas_udf(FRONTMATTER)
def _frontmatter(text: pd.Series) -> pd.DataFrame:
    import json

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    def one(content):
        rows = (content or "").split("\n")
        bad = (False, None, None, None, [], None)
        if len(rows) < 3 or rows[0].strip() != "---":
            return bad
        end = next((i for i, x in enumerate(rows[1:], 1) if x.strip() == "---"), None)
        if end is None:
            return bad
        try:
            data = yaml.load("\n".join(rows[1:end]), loader)
        except yaml.YAMLError:
            return bad
        data = {} if data is None else data
        if not isinstance(data, dict) or not isinstance(data.get("source_refs") or [], list):
            return bad
        plain = {k: "" if data.get(k) is None else str(data[k]).strip() for k in ("id", "title", "type")}
        extras = {str(k).strip(): v for k, v in data.items() if str(k).strip() not in ("id", "title", "type", "source_refs")}
        return (True, plain["id"], plain["title"], plain["type"], [str(x).strip() for x in data.get("source_refs") or []], json.dumps(extras, default=str, sort_keys=True) if extras else None)

    return pd.DataFrame([one(x) for x in text], columns=["ok", "id", "title", "type", "source_refs", "extras"])
