"""Audit of how filters act on each other: what each removes in every order in which they may be applied.

Each document is reduced to a mask, one bit for each filter that it fails, and the documents of a part (a source) to
cells: counts by mask. A recursive query then walks all orders over the masks: it starts from the empty prefix, extends each prefix
by every letter that it lacks, and carries the bits applied so far; each level of the recursion tells for that step which
masks are kept, removed, redundant or fail nothing else. Joined with the cells this gives the metrics of every prefix.
The recursion is as large as letters and masks make it (325 prefixes, 32 masks), whatever the number of rows and parts.

Texts are read once and never shuffled; identical texts meet by their SHA-256. Joins that a hot text, a hot id or many
null ids could load join two written tables, so that the engine splits skewed partitions.

Defined cases: a null text is empty (fails A alone, and E if an empty text has a smaller id); a null source is the part ''; a null id is
smaller than none and none is smaller, so it neither fails E nor has labels; rows that repeat an id are rows like others, of
which none is smaller than the other; several labels of an id count if one says so; a very long text is one row; an
empty table has no part and no row; further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.llm.common import text_or_empty, written

#: Filters by letter, in the order of their bits, and the most that one recursion takes.
LETTERS, MOST_LETTERS = "ABCDE", 6


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions under which a text fails, but for E, which looks at other texts."""
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits A to E), as a written narrow table."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("body"))
    rows = rows.withColumn("words", F.array_remove(F.split("body", r"[\x20\x09-\x0D]+"), ""))
    bits = sum((F.when(fails, 1 << LETTERS.index(x)).otherwise(0) for x, fails in text_failures(F.col("body"), F.col("words")).items()), F.lit(0))
    narrow = written(rows.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("sha")), "op11-texts")
    # texts that two ids share, each with its least id
    shared = narrow.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = written(shared.select("sha", "first"), "op11-firsts")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return narrow.join(firsts, "sha", "left").select("doc_id", "part", (F.col("bits") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled so."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    told = written(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).where("good + toxic > 0"), "op11-labels")
    rows = masks.join(told, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def walk(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """prefix, step, letter, mask and four flags (kept, removed, redundant, alone) for every prefix of every order and every mask."""
    if not 1 <= len(letters) <= MOST_LETTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_LETTERS} different letters")
    return spark.sql(
        """WITH RECURSIVE walk(prefix, step, letter, bit, before, mask) AS (
          SELECT '', 0, '', 0, 0, CAST(id AS INT) FROM range(:masks)
          UNION ALL
          SELECT concat(prefix, x), step + 1, x, shiftleft(1, instr(:letters, x) - 1), before | bit, mask
          FROM walk LATERAL VIEW explode(filter(split(:letters, ''), c -> instr(prefix, c) = 0)) t AS x
          WHERE step < :n
        )
        SELECT prefix, step, letter, mask, (mask & (before | bit)) = 0 AS kept, (mask & before) = 0 AND (mask & bit) <> 0 AS removed,
          (mask & before) <> 0 AND (mask & bit) <> 0 AS redundant, mask = bit AS alone
        FROM walk WHERE step > 0""",
        {"masks": 1 << len(letters), "letters": letters, "n": len(letters)},
    )


def orders(walked: DataFrame, letters: str = LETTERS) -> DataFrame:
    """filter_order, step, prefix: every order with each of its prefixes."""
    full = walked.where((F.col("step") == len(letters)) & (F.col("mask") == 0)).select(F.col("prefix").alias("filter_order"))
    return full.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.substring(F.col("filter_order"), F.lit(1), F.col("step")))


def audited(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from cells (part, mask, n, good, toxic)."""
    last, walked = len(letters), written(walk(cells.sparkSession, letters), "op11-walk")
    count = lambda flag, what, name: F.sum(F.when(F.col(flag), F.col(what)).otherwise(0)).cast("long").alias(name)
    # the table of the recursion is bounded by the number of letters
    steps = cells.join(F.broadcast(walked), "mask").groupBy("part", "prefix").agg(
        count("kept", "n", "kept"), count("removed", "n", "removed"), count("redundant", "n", "redundant"), count("alone", "n", "unique_fails"), count("removed", "good", "good_lost"), count("removed", "toxic", "toxic_lost")
    )
    # a prefix stands in as many orders as what is left of the letters has
    letter, more = F.substring("prefix", -1, 1), F.factorial(F.lit(last) - F.char_length("prefix"))
    shares = steps.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * more).cast("long").alias("shapley"))
    found = steps.withColumn("letter", letter).join(shares, ["part", "letter"])
    return found.join(F.broadcast(orders(walked, letters)), "prefix").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over documents and their labels, by source."""
    # written, since both the steps and their sums read the cells
    return audited(written(cells(masked(docs), labels), "op11-cells"))
