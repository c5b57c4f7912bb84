"""Import of Markdown and Obsidian trees: scan, catalog, link resolution, page and index rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamstack.functions.lexical import trimmed


def inputs(files: DataFrame) -> DataFrame:
    """Files (path relative to the tree) without dot files and folders; ``note`` tells Markdown from assets."""
    return files.where(~F.col("path").rlike(r"(^|/)\.")).withColumn("note", F.lower("path").endswith(".md"))


def reference_key(text: Column) -> Column:
    """How a note is referred to: forward slashes, no leading ./, no Markdown ending."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed(text), r"\\", "/"), r"^\./", ""), r"(?i)\.md$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def catalog(files: DataFrame) -> DataFrame:
    """kind (1 note by path, 2 note by name, 3 asset by path, 4 asset by name), key, value. A name that two files share has no entry."""
    notes = files.where("note").withColumn("value", F.concat(F.lit("notes/"), reference_key(F.col("path"))))
    assets = files.where("NOT note").withColumn("value", F.concat(F.lit("wiki/assets/"), F.col("path")))
    exact = notes.select(F.lit(1).alias("kind"), reference_key(F.col("path")).alias("key"), "value").unionByName(assets.select(F.lit(3).alias("kind"), F.col("path").alias("key"), "value"))
    named = notes.select(F.lit(2).alias("kind"), base_name(reference_key(F.col("path"))).alias("key"), "value").unionByName(assets.select(F.lit(4).alias("kind"), base_name(F.col("path")).alias("key"), "value"))
    single = named.groupBy("kind", "key").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other").drop("other")
    return exact.unionByName(single)


def resolved(references: DataFrame, names: DataFrame) -> DataFrame:
    """The references (target) with ``value`` and ``kind`` of the first catalog entry that matches: note by path, by name, asset by path, by name."""
    keys = F.array(
        F.struct(F.lit(1).alias("kind"), reference_key(F.col("target")).alias("key")),
        F.struct(F.lit(2).alias("kind"), F.regexp_replace(base_name(reference_key(F.col("target"))), r"(?<=.)\.[^.]*$", "").alias("key")),
        F.struct(F.lit(3).alias("kind"), F.regexp_replace(trimmed(F.col("target")), r"^\./", "").alias("key")),
        F.struct(F.lit(4).alias("kind"), base_name(trimmed(F.col("target"))).alias("key")),
    )
    targets = references.select("target").distinct()
    hits = targets.select("target", F.explode(keys).alias("k")).select("target", "k.*").where("key <> ''").join(names, ["kind", "key"])
    best = hits.groupBy("target").agg(F.min_by(F.struct("kind", "value"), "kind").alias("hit")).select("target", "hit.kind", "hit.value")
    return references.join(best, "target", "left")


def wiki_references(notes: DataFrame) -> DataFrame:
    """path, raw, target, alias, anchor, embed of the [[...]] references of notes (path, body)."""
    found = F.regexp_extract_all(F.col("body"), F.lit(r"(?s)(!?\[\[.*?\]\])"), F.lit(1))
    inside = F.regexp_replace(F.regexp_replace("whole", r"^!?\[\[", ""), r"\]\]$", "")
    rows = notes.select("path", F.posexplode(found).alias("place", "whole")).withColumn("raw", inside)
    left = F.substring_index("raw", "|", 1)
    return rows.select(
        "path", "place", "whole", "raw",
        trimmed(F.substring_index(left, "#", 1)).alias("target"),
        trimmed(F.when(F.col("raw").contains("|"), F.regexp_replace("raw", r"(?s)^[^|]*\|", "")).otherwise("")).alias("alias"),
        trimmed(F.when(left.contains("#"), F.regexp_replace(left, r"(?s)^[^#]*#", "")).otherwise("")).alias("anchor"),
        F.col("whole").startswith("!").alias("embed"),
    )


def replacement(up: Column) -> Column:
    """The text that takes a resolved reference's place; ``up`` is the way from the note's folder to the wiki root."""
    mark = F.when(F.col("embed"), "!").otherwise("")
    page = F.concat(mark, F.lit("[["), F.col("value"), F.when(F.col("anchor") != "", F.concat(F.lit("#"), F.col("anchor"))).otherwise(""), F.when(F.col("alias") != "", F.concat(F.lit("|"), F.col("alias"))).otherwise(""), F.lit("]]"))
    link = F.concat(up, F.regexp_replace("value", "^wiki/", ""))
    asset = F.when(F.col("embed"), F.concat(F.lit("![]("), link, F.lit(")"))).otherwise(F.concat(F.lit("["), F.when(F.col("alias") != "", F.col("alias")).otherwise(base_name(F.col("value"))), F.lit("]("), link, F.lit(")")))
    lost = F.when(F.col("embed"), F.concat(F.lit("![unsupported obsidian embed]("), trimmed(F.col("raw")), F.lit(")"))).otherwise(F.concat(F.lit("[["), F.col("raw"), F.lit("]]")))
    return F.when(F.col("kind") <= 2, page).when(F.col("kind") >= 3, asset).otherwise(lost)


def rewritten(notes: DataFrame, names: DataFrame) -> DataFrame:
    """The notes (path, body) with their references rewritten. References resolve in joins; a note's own replacements meet in its row."""
    up = F.expr("repeat('../', size(split(concat('notes/', path), '/')) - 1)")
    new = resolved(wiki_references(notes), names).withColumn("new", replacement(up))
    by_note = new.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "new"))).alias("news"))
    joined = notes.join(by_note, "path", "left")
    rest = F.split("body", r"(?s)!?\[\[.*?\]\]", -1)
    parts = F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.try_element_at(F.col("news.new"), i + 1), F.lit(""))))
    return joined.withColumn("body", F.array_join(parts, "")).drop("news")


@F.pandas_udf(T.StringType())
def rendered_page(page_id: pd.Series, title: pd.Series, refs: pd.Series, extras: pd.Series, body: pd.Series) -> pd.Series:
    """A page with its frontmatter: id, title, type note, sources, then what else its own frontmatter held."""
    import json

    import yaml

    def one(i, t, r, e, b):
        data = {"id": i, "title": t, "type": "note", "source_refs": list(r)} | (json.loads(e) if e else {})
        text = f"---\n{yaml.safe_dump(data, allow_unicode=True, sort_keys=False)}---\n\n{(b or '').strip()}"
        return text + "\n"

    return pd.Series([one(*x) for x in zip(page_id, title, refs, extras, body)])


def rendered_index(pages: DataFrame) -> DataFrame:
    """One row, body: an index line for each page in path order."""
    line = F.struct("path", F.concat(F.lit("- [["), F.col("page_id"), F.lit("|"), F.col("title"), F.lit("]]")).alias("line"))
    return pages.agg(F.sort_array(F.collect_list(line)).alias("x")).select(F.concat(F.lit("# Index\n\n"), F.array_join("x.line", "\n"), F.lit("\n")).alias("body"))


def tree(spark, root: str) -> DataFrame:
    """path (relative to the root), content of every file of a tree."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    marker = base.rsplit("/", 1)[-1]
    return found.select(F.regexp_extract("path", rf"^.*?/\Q{marker}\E/(.*)$", 1).alias("path"), "content")


def require_disjoint(spark, one: str, other: str) -> None:
    """Raise if one of two folders is the other or lies in it: an import must not read what it writes."""
    from urllib.parse import unquote, urlsplit

    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def place(name: str) -> list[str]:
        path = hadoop.Path(name)
        url = urlsplit(path.getFileSystem(conf).makeQualified(path).toString())
        return [f"{url.scheme}://{url.netloc}", *(x for x in unquote(url.path).split("/") if x)]

    a, b = place(one), place(other)
    if a[: len(b)] == b or b[: len(a)] == a:
        raise ValueError(f"{one} and {other} overlap")
