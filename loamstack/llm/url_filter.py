"""Operator 4: URL filtering by a temporal list join. DataFrame functions only.

A list is a log of dated entries (list_name, pattern, action, effective_on); a
pattern is a domain, optionally with a path prefix, and covers subdomains.
``intervals`` turns the log into validity intervals [valid_from, valid_to): an
``add`` holds until the pattern's next entry. ``judge`` gives every capture the
entries active on its day.

Hosts repeat far more often than they differ, so the list's domains first meet
the distinct hosts: for each host, the domains above it that are listed and the
lengths of their path prefixes. A capture then looks up the exact keys (domain,
prefix) that can concern it, each of which has one timeline: the intervals of one
pattern over all lists. So neither a host with many entries nor one with many
captures gathers in one row or task: entries are dealt by (domain, prefix),
captures by host, path and day, and the as-of part is a filter over one pattern's
timeline.

Defined cases: a null or unparsable URL has the host '' and no entry; patterns are
compared in the lower case of their domain, without a final dot; entries with a null
pattern or date or another action are ignored; entries of one pattern and day apply in the
order add, remove; captures without a day meet no entry; repeated captures are judged one
by one; very long URLs are looked up by the prefixes that are listed only; without
entries nothing is blocked, and an empty table gives an empty result; columns of the
captures that are named like added ones are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstack.llm.common import unused, written


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot; '' if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path, without query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, domain, prefix, valid_from, valid_to (null: still valid) of the entries."""
    slash = F.instr("pattern", "/")
    known = entries.where("pattern IS NOT NULL AND effective_on IS NOT NULL AND action IN ('add', 'remove')").select(
        "list_name",
        F.regexp_replace(F.lower(F.when(slash > 0, F.expr("substring(pattern, 1, instr(pattern, '/') - 1)")).otherwise(F.col("pattern"))), r"\.$", "").alias("domain"),
        F.when(slash > 0, F.expr("substring(pattern, instr(pattern, '/'))")).otherwise("").alias("prefix"),
        "action",
        "effective_on",
    )
    # of one pattern and day the removal is the last word, and a repeated entry says nothing new
    order = Window.partitionBy("list_name", "domain", "prefix").orderBy("effective_on", "action")
    spans = known.distinct().withColumn("valid_to", F.lead("effective_on").over(order)).where("action = 'add' AND (valid_to IS NULL OR valid_to > effective_on)")
    return spans.select("list_name", "domain", "prefix", F.col("effective_on").alias("valid_from"), "valid_to")


def listed(hosts: DataFrame, spans: DataFrame) -> DataFrame:
    """host, keys: the listed domains at or above each host, and the lengths of their prefixes."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = spans.groupBy("domain").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    wide = hosts.where("host <> ''").withColumn("domain", F.explode(above)).join(lengths, "domain")
    return wide.groupBy("host").agg(F.collect_list(F.struct("domain", "lengths")).alias("keys"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """The captures with host, n_active, lists (names of the active lists, sorted), since (the latest active entry's day) and blocked added."""
    added = ["host", "n_active", "lists", "since", "blocked"]
    kept = [c for c in captures.columns if c not in added]
    own_path, own_day, m_host, m_path, m_day, m = unused(captures, "url_path", "url_day", "met_host", "met_path", "met_day", "met")
    rows = captures.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias(own_path), F.col(day_col).alias(own_day))
    spans = written(intervals(entries), "intervals")
    asked = rows.select("host", F.col(own_path).alias("path"), F.col(own_day).alias("day")).where("host <> '' AND day IS NOT NULL").distinct()
    keys = written(listed(asked.select("host").distinct(), spans), "listed")
    known = asked.join(keys, "host").withColumn("k", F.explode("keys")).select("host", "path", "day", "k.domain", F.explode("k.lengths").alias("n")).where(F.col("n") <= F.length("path"))
    timelines = spans.groupBy("domain", "prefix").agg(F.collect_list(F.struct("valid_from", "valid_to", "list_name")).alias("timeline"))
    met = known.select("host", "path", "day", "domain", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("prefix")).join(timelines, ["domain", "prefix"])
    active = F.filter("timeline", lambda x: (x["valid_from"] <= F.col("day")) & (x["valid_to"].isNull() | (x["valid_to"] > F.col("day"))))
    found = met.select("host", "path", "day", active.alias("active")).where(F.size("active") > 0)
    found = found.groupBy("host", "path", "day").agg(
        F.sum(F.size("active")).cast("long").alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("active", lambda x: x["list_name"]))))).alias("names"),
        F.max(F.array_max(F.transform("active", lambda x: x["valid_from"]))).alias("since"),
    )
    found = written(found.select(F.col("host").alias(m_host), F.col("path").alias(m_path), F.col("day").alias(m_day), F.struct("n", "names", "since").alias(m)), "met")
    joined = rows.join(found, (F.col("host") == F.col(m_host)) & (F.col(own_path) == F.col(m_path)) & (F.col(own_day) == F.col(m_day)), "left")
    return joined.select(
        *kept,
        "host",
        F.coalesce(F.col(f"{m}.n"), F.lit(0)).cast("long").alias("n_active"),
        F.coalesce(F.array_join(F.col(f"{m}.names"), ","), F.lit("")).alias("lists"),
        F.col(f"{m}.since").alias("since"),
        F.col(m).isNotNull().alias("blocked"),
    )
