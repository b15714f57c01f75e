"""Quality rules by distribution divergence, in built-in functions only.

The base rules count words, symbols, repeated lines and repeated five-word windows.  The
verdict compares two histograms of a document, its character classes and its common words,
with references of its language by Jensen-Shannon distance.  References are taken from all
documents of a language together; documents too short for a histogram are not judged by it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"\x20\x09-\x0D"
# character classes, taken out of the text one after the other; the last one is what is left
CLASSES = {"lower": r"\p{Ll}+", "space": f"[{SPACE}]+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "point": r"[.,;:!?'\"()-]+"}
COMMON_WORDS = 16
CLASS_LIMIT, WORD_LIMIT = 0.25, 0.45
MIN_CHARS, MIN_WORDS = 200, 50
BROADCAST_LANGUAGES = 10_000


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda's argument is not copied into its uses."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = 5) -> Column:
    """Number of words that lie in an ``n``-word window found twice or more in the array."""
    size = F.size(words)
    hashes = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)]))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # a window counts if a neighbour in hash order has its hash
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")), lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(n), x - acc["last"])).alias("sum"), x.alias("last")), lambda acc: acc["sum"])
    # most texts repeat no window: only the others are sorted
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bound(placed(h), lambda s: covered(twice(s))))
    return F.when(size <= n, F.lit(0)).otherwise(_bound(_bound(words, hashes), count)).cast("long")


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("rest0"))
    out = out.withColumn("words", F.array_remove(F.split(F.regexp_replace("rest0", r"[\x09-\x0D]", " "), " "), ""))
    lines = F.filter(F.split("rest0", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.withColumn("lines", lines)
    for k, pattern in enumerate(CLASSES.values()):
        out = out.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", pattern, ""))
    last = f"rest{len(CLASSES)}"
    counts = [(F.length(f"rest{k}") - F.length(f"rest{k + 1}")).alias(name) for k, name in enumerate(CLASSES)]
    k = list(CLASSES).index("space")
    spaces = F.length(f"rest{k}") - F.length(f"rest{k + 1}")
    return out.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("rest0") - spaces).cast("long").alias("word_chars"),
        (F.length(last) - F.length(F.regexp_replace(last, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*counts, F.length(last).alias("other")).alias("classes"),
        "words",
    )


def language_references(rows: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """``(lang, ref_words, longest, ref_shares, ref_classes)`` from all of ``measured()``'s rows of each
    language; the row of the null language is taken from the rows of all languages together."""
    sums = [F.sum(F.col("classes")[k].cast("double")).alias(f"c{k}") for k in range(len(CLASSES) + 1)]
    none = F.lit(None).cast("string").alias("lang")
    counted = materialize(rows.select("lang", F.explode("words").alias("word")).groupBy("lang", F.lower("word").alias("word")).count(), "counted")
    totals = counted.groupBy(F.col("lang").alias("of")).agg(F.sum("count").alias("total"))
    by_lang = rows.where("word_chars > 0").groupBy("lang").agg(*sums)
    by_lang = materialize(by_lang.join(totals, F.col("lang").eqNullSafe(F.col("of"))).drop("of"), "languages")
    again = [F.sum(c).alias(c) for c in by_lang.columns[1:]]
    whole = by_lang.where("lang is not null").unionByName(by_lang.groupBy().agg(*again).where("total > 0").select(none, "*"))
    ranked = counted.where("lang is not null").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("rank") <= common_words)
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "count"))).alias("top"))
    overall = counted.groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word").limit(common_words)
    placed = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("low"), "word", "count")))
    placed = F.transform(placed, lambda t, i: F.struct((i + 1).alias("rank"), t["word"].alias("word"), t["count"].alias("count")))
    top = top.unionByName(overall.groupBy().agg(placed.alias("top")).where(F.size("top") > 0).select(none, "top"))
    shares = F.array(*[f"c{k}" for k in range(len(sums))])
    return whole.alias("w").join(top.withColumnRenamed("lang", "of"), F.col("w.lang").eqNullSafe(F.col("of")), "left").select(
        "lang",
        F.col("top.word").alias("ref_words"),
        F.array_max(F.transform("top", lambda t: F.length(t["word"]))).alias("longest"),
        F.transform("top", lambda t: t["count"] / F.col("total")).alias("ref_shares"),
        F.transform(shares, lambda c: c / F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)).alias("ref_classes"),
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) / 2 + term(b, (a + b) / 2) / 2)
    # rounding may leave a zero below zero; abs, unlike greatest, keeps the null of a missing histogram
    return F.sqrt(F.abs(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Counts, divergences and verdict of every row.

    Null and empty texts have no word and fail the base rules.  A null language is
    judged against the reference of all documents.  A document with fewer than ``min_chars``
    characters, or ``min_words`` words, is not judged by the class, or word, histogram: its
    divergence is null and it passes.  Repeated rows are judged each; a null id is kept.
    """
    # the words are not written: what the references need of them is read again with the texts
    rows = measured(docs, id_col, text_col, lang_col)
    references = materialize(language_references(rows), "references").withColumnRenamed("lang", "of")
    if references.count() <= BROADCAST_LANGUAGES:
        references = F.broadcast(references)
    rows = rows.join(references, F.col("lang").eqNullSafe(F.col("of")), "left")
    chars = reduce(add, [F.col("classes")[k] for k in range(len(CLASSES) + 1)])
    own_classes = F.transform("classes", lambda c: c / chars)
    # lower case never makes a word shorter, so most words are passed over by their length
    common = F.transform(F.filter("words", lambda w: (F.length(w) <= F.col("longest")) & F.array_contains("ref_words", F.lower(w))), lambda w: F.lower(w))
    counts = _bound(common, lambda c: F.transform("ref_words", lambda r: F.size(F.filter(c, lambda w: w == r)) / F.col("n_words")))
    rows = rows.withColumn("shares", F.when(F.col("n_words") >= min_words, counts))
    rest = lambda a: F.concat(a, F.array(F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)))
    rows = rows.withColumn("class_distance", F.when(chars >= min_chars, divergence(own_classes, F.col("ref_classes"))))
    rows = rows.withColumn("word_distance", divergence(rest(F.col("shares")), rest(F.col("ref_shares"))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    strange = F.coalesce(F.col("class_distance") > class_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > word_limit, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~strange).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
