"""Operator 8, quality rules: fixed text statistics, and a hashed n-gram log-likelihood ratio.

Words and word pairs fall into BUCKETS hash buckets. Two multinomials over the buckets, that of trusted documents and
that of the raw corpus, give each bucket a log-likelihood ratio in whole thousandths; a document's score is the mean
over its n-grams, and every document is held against the same threshold. DataFrame functions only.

The raw counts cover all documents. The trusted ones come from at most TRUSTED_DOCS labelled documents.

Defined results: a null or empty text has no words, statistics of 0, fails the fixed rules and is not kept. Repeated
rows are judged one by one; a null doc_id is kept and never trusted. Without trusted documents every ratio is 0 and
only the fixed rules decide. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.common import let, words

#: Hash buckets of the multinomials, added to every count, the least mean ratio of a kept document, trusted documents.
BUCKETS, SMOOTHING, LEAST_SCORE, TRUSTED_DOCS = 1 << 16, 1.0, -0.35, 20_000
#: Ratios are kept as whole numbers of so many parts of 1, so sums don't depend on their order.
PARTS = 1000
SYMBOLS = r"[^#*$%&|<>]+"


def bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(BUCKETS - 1))


def ngrams(w: Column) -> Column:
    """Buckets of the words and word pairs of an array of words."""
    one = F.transform(w, lambda x: bucket(x))
    two = let(w, lambda v: F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: bucket(F.get(v, i), x)))
    return F.concat(one, two)


def repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more, by sorting the windows' hashes."""

    def spread(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda e, x, k: F.coalesce(F.get(e, k).h == x.h, F.lit(False))
        at = let(pairs, lambda e: F.sort_array(F.transform(F.filter(e, lambda x, k: same(e, x, k - 1) | same(e, x, k + 1)), lambda x: x.i)))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")), lambda a: a.n)

    def over(v: Column) -> Column:
        h = F.transform(F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(v, i), F.get(v, i + 1), x))
        return let(h, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("bigint")).otherwise(spread(x)))

    return let(w, over)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, w (words) and the fixed statistics with base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), words(text).alias("w"))
    d = d.select(
        "doc_id", "w", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("bigint").alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, ratio: PARTS times the log of trusted over raw probability, for every bucket that occurs."""
    ids = labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).filter(F.col("doc_id").isNotNull()).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_DOCS).withColumn("trusted", F.lit(1))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id", "left")
    grams = d.select(F.coalesce("trusted", F.lit(0)).cast("bigint").alias("trusted"), F.explode(ngrams(words(F.col("text")))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good"))
    every = Window.partitionBy(F.lit(1))
    share = lambda c: (F.col(c) + SMOOTHING) / (F.sum(c).over(every) + SMOOTHING * BUCKETS)
    ratio = F.round(F.log(share("good") / share("raw")) * PARTS).cast("bigint")
    return counts.select("bucket", F.when(F.sum("good").over(every) > 0, ratio).otherwise(0).alias("ratio"))


def table(ratio: DataFrame) -> Column:
    """The ratios of all buckets as one constant array: BUCKETS numbers, whatever the corpus."""
    known = {r.bucket: r.ratio for r in ratio.collect()}
    return F.split(F.lit(",".join(str(known.get(k, 0)) for k in range(BUCKETS))), ",").cast("array<int>")


def judge(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Statistics, score (mean ratio) and verdict of every document."""
    t = table(ratios(docs, labels))
    total = F.aggregate(ngrams(F.col("w")), F.lit(0).cast("bigint"), lambda a, b: a + F.get(t, b.cast("int")))
    d = statistics(docs).withColumn("total", total)
    n = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    score = F.col("total") / (PARTS * n)
    kept = ~F.col("base_failed") & (F.col("total") >= least * PARTS * n)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), score.alias("score"))
