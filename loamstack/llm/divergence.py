"""Quality rules by distribution divergence: histograms of a document against those of its language.

Two histograms of each text, of character classes and of common words (a word that makes up at least one in 1000 of a
language's words, and one bin for all others), are compared with the same histograms of all documents of its language
by the Jensen-Shannon distance (base 2, 0 to 1). A document drawn from the reference itself lies away from it by chance,
the more the shorter it is: that expected divergence is known from the reference and the length, and a document is
rejected only where its divergence passes it by more than a margin. Guards: documents under a least number of words or
characters, and languages with few words, are not judged by divergence.

Everything is a DataFrame expression; no Python runs on the executors. Texts are read twice and never shuffled: once
for the counts of words by language, once for the counts of each document, which are kept in a narrow written table.

Defined cases: a null text has no words; a document without a language belongs to the language '' (null and '' are the
same); rows are judged each on its own, so repeated ids, repeated rows, null ids and ties change nothing but the
references; a very long text is one row of several times its size in memory; an empty table stays empty; further columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstack.llm.common import text_or_empty, written

#: White space that parts words; symbols that count as such.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Character classes in the order in which they are taken away; what is left is the class ``other``.
CLASSES = (("lower", r"[a-z]"), ("space", SPACE), ("letters", r"[^\x00-\x7F\P{L}]"), ("upper", r"[A-Z]"), ("digits", r"[0-9]"), ("stops", r"[.,;:!?'\"()\-]"), ("symbols", SYMBOLS))
NAMES = tuple(name for name, _ in CLASSES) + ("other",)
#: Base rules: least number of words, words of a window, share of repeated words in percent.
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
#: A word is common at one in so many; guards of a document and of a language; how far a divergence may pass the expected one.
COMMON, GUARD_WORDS, GUARD_CHARS, GUARD_LANGUAGE = 1000, 50, 200, 10_000
WORD_MARGIN, CLASS_MARGIN = 0.15, 0.1
#: Languages whose references are broadcast: the largest. Any other holds under one in so many of all words and is joined by a shuffle.
BROADCAST_LANGUAGES = 1000
#: Hash values by which rare words are left out early.
SIEVE = 1 << 16


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _window_hashes(words: Column) -> Column:
    """A hash of each window: of words, of pairs, of fours and then of five; what passes the end of the text is cut."""
    both = lambda a, b, by: F.zip_with(a, F.slice(b, by + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))
    fives = lambda h: let(both(h, h, 1), lambda p: let(both(p, p, 2), lambda q: both(q, h, 4)))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.slice(fives(h), F.lit(1), F.size(h) - WINDOW + 1))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of words which the text holds twice or more.

    Hashes tell the windows that may be repeated; only those are sorted and compared as they are.
    """
    of = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["w"] == b["w"], F.lit(False))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def exact(found: Column) -> Column:
        twice = F.filter(found, lambda x, k: same(x, F.get(found, k - 1)) | same(x, F.get(found, k + 1)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def suspects(h: Column) -> Column:
        # hashes in order, each with its place: equal ones are neighbours
        placed = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("w"), k.alias("i"))))
        some = let(placed, lambda p: F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1))))
        return F.sort_array(F.transform(some, lambda x: F.struct(of(x["i"]).alias("w"), x["i"].alias("i"))))

    return F.when(F.size(words) > WINDOW, let(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(suspects(h), exact)).otherwise(0))).otherwise(0)


def counted(sorted_words: Column) -> Column:
    """Array of (word, n) of a sorted array of words."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda w, k: F.when((k == 0) | (w != F.get(s, k - 1)), k)), lambda k: k.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("word"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).alias("n"))))

    return let(sorted_words, runs)


def with_language(docs: DataFrame) -> DataFrame:
    """doc_id, body, language."""
    return docs.select(F.col("doc_id"), text_or_empty().alias("body"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"))


def common_words(rows: DataFrame) -> DataFrame:
    """language, word, q, total: the share of each common word among all words of its language."""
    counts = rows.select("language", F.explode(words(F.lower("body"))).alias("word")).groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("language").agg(F.sum("n").alias("total"))
    return counts.join(total, "language").where(F.col("n") * COMMON >= F.col("total")).select("language", "word", (F.col("n") / F.col("total")).alias("q"), "total")


def measured(rows: DataFrame, likely: list[int]) -> DataFrame:
    """A narrow row for each document: the base counts, the class counts, and the counts of words whose hash is among ``likely``."""
    out = rows.withColumn("ws", words(F.col("body"))).withColumn("rest_0", F.col("body"))
    for k, (name, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"rest_{k + 1}", F.regexp_replace(f"rest_{k}", f"{pattern}+", "")).withColumn(name, F.char_length(f"rest_{k}") - F.char_length(f"rest_{k + 1}"))
    passing = F.filter("ws", lambda w: F.pmod(F.hash(F.lower(w)), F.lit(SIEVE)).isin(*likely)) if likely else F.array().cast("array<string>")
    hits = F.transform(passing, F.lower)
    n = F.size("ws").cast("long")
    return out.select(
        "doc_id", "language", n.alias("n_words"), (F.char_length("body") - F.col("space")).cast("long").alias("word_chars"), F.col("symbols").cast("long").alias("n_symbols"),
        duplicate_lines(F.col("body")).cast("long").alias("n_dup_lines"), repeated_words(F.col("ws")).cast("long").alias("n_repeat_words"), F.char_length("body").cast("long").alias("chars"),
        *[F.col(name).cast("long").alias(f"c_{name}") for name in NAMES[:-1]], F.char_length(f"rest_{len(CLASSES)}").cast("long").alias("c_other"), counted(F.sort_array(hits)).alias("hits"),
    )


def _half(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x / 2 * F.log2(x / m)).otherwise(0.0)
    return side(p) + side(q)


def _some(name: str) -> Column:
    """A count to divide by, also of an empty text (whose divergence no guard lets pass)."""
    return F.greatest(F.col(name), F.lit(1))


def _class_divergence(rows: DataFrame) -> Column:
    return sum((_half(F.col(f"c_{name}") / _some("chars"), F.col(f"q_{name}")) for name in NAMES), F.lit(0.0))


def _expected(q: Column, n: Column) -> Column:
    """What chance adds to a bin's part in a sample of n: the quadratic term, and not more than an empty bin gives."""
    return F.least(q / 2, F.lit(1.0) / (8 * n * F.lit(0.6931471805599453)))


def references(table: DataFrame, common: DataFrame) -> DataFrame:
    """language, judged words and the histograms: q_<class>, share of the common words, the list of their shares."""
    sums = table.groupBy("language").agg(F.sum("chars").alias("all_chars"), *[F.sum(f"c_{name}").alias(f"s_{name}") for name in NAMES])
    shares = common.groupBy("language").agg(F.first("total").alias("total"), F.sort_array(F.collect_list("q")).alias("shares"))
    return sums.join(shares, "language", "left").select(
        "language", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("shares", F.array().cast("array<double>")).alias("shares"),
        *[(F.col(f"s_{name}") / F.greatest("all_chars", F.lit(1))).alias(f"q_{name}") for name in NAMES],
    )


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], languages: int, top: DataFrame) -> DataFrame:
    """``rows`` left joined with a table of references: those of the largest languages by a broadcast, any others by a shuffle."""
    if languages <= BROADCAST_LANGUAGES:
        return rows.join(F.broadcast(small), keys, "left")
    large, rest = small.join(top, "language", "left_semi"), small.join(top, "language", "left_anti")
    near, far = rows.join(F.broadcast(top), "language", "left_semi"), rows.join(F.broadcast(top), "language", "left_anti")
    return near.join(F.broadcast(large), keys, "left").unionByName(far.join(rest, keys, "left"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance (null where a guard holds)."""
    rows = with_language(docs)
    common = written(common_words(rows), "op12-common")
    likely = [r[0] for r in common.select(F.pmod(F.hash("word"), F.lit(SIEVE)).alias("h")).distinct().collect()]  # at most SIEVE numbers
    table = written(measured(rows, likely).withColumn("row", F.monotonically_increasing_id()), "op12-measured")
    refs = written(references(table, common), "op12-references")
    languages = refs.count()
    top = refs.orderBy(F.desc("total"), "language").limit(BROADCAST_LANGUAGES).select("language")
    word = F.col("hit.n") / _some("n_words")
    terms = table.select("row", "language", "n_words", F.explode("hits").alias("hit")).withColumn("word", F.col("hit.word"))
    # of the bins that the document has: their parts, less what they would add if it had none of them
    held = _joined(terms, common.select("language", "word", "q"), ["language", "word"], languages, top).where("q IS NOT NULL")
    sums = held.groupBy("row").agg(F.sum(_half(word, F.col("q")) - F.col("q") / 2).alias("parts"), F.sum("hit.n").alias("n_common"))
    judged = _joined(table.drop("hits").join(sums, "row", "left"), refs, ["language"], languages, top)
    share = F.aggregate("shares", F.lit(0.0), lambda a, q: a + q)
    rare = F.greatest(1 - share, F.lit(0.0))
    divergence = F.coalesce("parts", F.lit(0.0)) + share / 2 + _half(1 - F.coalesce("n_common", F.lit(0)) / _some("n_words"), rare)
    chance = F.aggregate("shares", _expected(rare, _some("n_words")), lambda a, q: a + _expected(q, _some("n_words")))
    class_chance = sum((_expected(F.col(f"q_{name}"), _some("chars")) for name in NAMES), F.lit(0.0))
    trusted = F.col("total") >= GUARD_LANGUAGE
    by_word, by_class = trusted & (F.col("n_words") >= GUARD_WORDS), trusted & (F.col("chars") >= GUARD_CHARS)
    out = judged.withColumn("wd", F.when(by_word, divergence)).withColumn("cd", F.when(by_class, _class_divergence(judged)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    usual = F.coalesce(F.col("wd") <= chance + WORD_MARGIN, F.lit(True)) & F.coalesce(F.col("cd") <= class_chance + CLASS_MARGIN, F.lit(True))
    distance = lambda c: F.when(F.col(c).isNotNull(), F.round(F.sqrt(F.greatest(F.col(c), F.lit(0.0))), 6))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & usual).alias("kept"), distance("cd").alias("class_distance"), distance("wd").alias("word_distance"))
