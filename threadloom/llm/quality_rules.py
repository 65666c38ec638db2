"""Quality rules by a log-likelihood ratio of hashed n-grams, DataFrame functions only.

Two multinomials over hashed n-grams are counted, one over the trusted
documents, one over the whole raw corpus. The n-grams are words and the three
characters at either end of each, which tell prose from lists, shouting and
signs in any language and are frequent in small corpora too, and pairs of
neighbours. Of pairs only one class is told apart, a word after itself: pairs of
unlike words are too many for a corpus to know its good ones, but trusted texts
hardly ever stutter. A document's score is the mean of ``log(trusted / raw)`` over
its single n-grams plus that over its pairs, so it doesn't depend on its length,
and every document at or above a fixed threshold stays. Base rules turn down
documents that are too short or repeat themselves.

Null and empty texts have no words: all counts are 0, the score is 0 and the
base rules reject them. Repeated rows are judged one by one, with equal
results. Without trusted documents all ratios are equal, so only the base rules
decide. Rows without an id are raw text only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import BLANK, let, packed, unpacked, whole_text
from threadloom.session import settle

# What parts words besides the space.
OTHER_BLANKS = "\t\n\x0b\x0c\r"
# Hash buckets of the n-grams; bounds the table of ratios that each task holds.
BUCKETS = 1 << 16
# What is added to each bucket's counts.
SMOOTHING = 4.0
# Mean log ratio from which a document stays.
THRESHOLD = -0.5
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
EDGE = 3
# Stands for a stutter among the hashes of n-grams.
STUTTER = -(2**63)


def with_words(docs: DataFrame) -> DataFrame:
    """``doc``, its ``text`` and ``words``, the words' 64-bit hashes ``h`` and those of word pairs, ``h2``.

    Each word pairs with its predecessor, the first one with nothing.
    """
    df = packed(docs).withColumn("text", whole_text("doc.text"))
    blank = reduce(lambda text, c: F.replace(text, F.lit(c), F.lit(" ")), OTHER_BLANKS, F.col("text"))
    df = df.withColumn("words", F.array_remove(F.split(blank, " "), ""))
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("h2", F.transform("h", lambda x, i: F.xxhash64(F.get(F.col("h"), i - 1), x)))


def bucket_of(ngram: Column, buckets: int) -> Column:
    return F.pmod(ngram, F.lit(buckets)).cast("int")


def n_repeated_words(h2: Column) -> Column:
    """Words that lie in a window of eight words found more than once in the text.

    Windows are compared by 64-bit hashes, built from those of pairs and fours.
    A window that comes again brings five fours that were there before, so the
    windows of a text with fewer such fours need not be looked at.
    """
    none = F.array().cast("array<int>")
    starts = lambda size, first: F.when(size > first, F.sequence(F.lit(first), size - 1)).otherwise(none)
    no_words = F.lit(0).cast("long")

    def repeated(pairs: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(pairs, i)["w"] == x["w"], F.lit(False))
        places = F.sort_array(
            F.transform(F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])
        )
        # Each place adds the words that the place before it doesn't cover.
        new = lambda p: F.transform(
            p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(at - F.get(p, k - 1), F.lit(WINDOW))).cast("long")
        )
        return let(places, lambda p: F.aggregate(new(p), no_words, lambda total, x: total + x))

    def counted(fours: Column) -> Column:
        # fours[k] ends at word k + 3, so the window of fours k and k + 4 starts at word k.
        windows = F.transform(
            starts(F.size(fours), 4),
            lambda i: F.struct(F.xxhash64(F.get(fours, i - 4), F.get(fours, i)).alias("w"), (i - 4).alias("i")),
        )
        few = F.size(fours) - F.size(F.array_distinct(fours)) < WINDOW - 3
        return F.when(few, no_words).otherwise(let(F.sort_array(windows), repeated))

    fours = F.transform(starts(F.size(h2), 3), lambda i: F.xxhash64(F.get(h2, i - 2), F.get(h2, i)))
    return let(fours, counted)


def measures(df: DataFrame) -> DataFrame:
    """Adds the base counts and the base verdict to the columns of ``with_words``."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK[1:]}"))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    return df.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(F.col("text").rlike("[#*$%&|<>]"), symbols).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        n_repeated_words(F.col("h2")).alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    )


def n_stutters() -> Column:
    """How many words of ``with_words`` follow themselves."""
    return F.size(F.filter("h", lambda x, i: F.get(F.col("h"), i - 1) == x))


def ngrams(*more: Column) -> Column:
    """All single n-grams of ``with_words``: each word, and the characters at its start and at its end; then ``more``."""
    edge = lambda cut, mark: F.transform("words", lambda w: F.xxhash64(cut(w, F.lit(EDGE)), F.lit(mark)))
    return F.concat("h", edge(F.left, 1), edge(F.right, 2), *more)


def log_ratios(
    docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING
) -> DataFrame:
    """One row ``ratios``: by bucket, ``log(trusted / raw)`` of the smoothed multinomials, then that of pairs of equal
    words and that of other pairs.

    Counts cover every n-gram of every document. Raw counts leave one occurrence
    out, the one that is scored, and both counts are smoothed towards the same
    rate: what occurs only once is worth nothing, so that rare words of a document
    that nobody has looked at don't speak against it.
    Documents meet the trusted ids once, hashed by id at any size; counts are
    summed per task before they are shuffled.
    """
    ids = trusted_ids.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = ids.hint("shuffle_hash")
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    marked = marked.select("text", F.col("trusted_id").isNotNull().cast("long").alias("trusted"))
    counts = (
        with_words(marked)
        .select(F.col("doc.trusted").alias("trusted"), F.explode(ngrams(F.array_repeat(F.lit(STUTTER), n_stutters()))).alias("ngram"))
        .groupBy(F.when(F.col("ngram") == STUTTER, buckets).otherwise(bucket_of(F.col("ngram"), buckets)).alias("bucket"))
        .agg(F.sum("trusted").alias("trusted"), F.count("*").alias("raw"))
    )
    # The last bucket has the stutters.
    every = docs.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("trusted", F.lit(0)).alias("trusted"), F.coalesce("raw", F.lit(0)).alias("raw")
    )
    # One array of ``buckets`` numbers and two, whatever the corpus.
    single = F.col("bucket") < buckets
    sums = filled.agg(
        F.sum(F.when(single, F.col("trusted"))).alias("trusted"), F.sum(F.when(single, F.col("raw"))).alias("raw"),
        F.sort_array(F.collect_list(F.struct("bucket", "trusted", "raw"))).alias("rows"),
    )
    sums = sums.withColumn("scale", F.when(F.col("trusted") > 0, F.col("raw") / F.col("trusted")))
    ratio = lambda x: (x["trusted"] * F.col("scale") + smoothing) / (F.greatest(x["raw"] - 1, F.lit(0)) + smoothing)
    stutters = F.element_at("rows", -1)
    # A word has three single n-grams. Pairs of unlike words are all the others.
    others = lambda words, own: F.greatest(words / 3 - own, F.lit(0))
    good = others(F.col("trusted"), stutters["trusted"]) * F.col("scale")
    unlike = (good + smoothing) / (others(F.col("raw"), stutters["raw"]) + smoothing)
    known = lambda x: F.coalesce(F.log(x), F.lit(0.0))
    return sums.select(F.concat(F.transform("rows", lambda x: known(ratio(x))), F.array(known(unlike))).alias("ratios"))


def judged(
    docs: DataFrame,
    trusted_ids: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """``doc`` (all columns), the base counts, ``base_failed``, ``llr`` and ``kept``.

    The table of ratios is made first, from all documents; then every document
    is scored where it was read, without a shuffle. Write the result before you
    filter it by its columns, as ``keep_good`` explains.
    """
    ratios = settle(log_ratios(docs, trusted_ids, buckets, smoothing), "ratios")
    df = measures(with_words(docs)).withColumn("ratios", ratios.scalar()).withColumn("stutters", n_stutters())
    total = F.aggregate(ngrams(), F.lit(0.0), lambda s, x: s + F.get(F.col("ratios"), bucket_of(x, buckets)))
    same, unlike = F.get(F.col("ratios"), F.lit(buckets)), F.get(F.col("ratios"), F.lit(buckets + 1))
    pairs = F.col("stutters") * same + (F.col("n_words") - F.col("stutters")) * unlike
    mean = total / (3 * F.col("n_words")) + pairs / F.col("n_words")
    return df.withColumn("llr", F.when(F.col("n_words") > 0, mean).otherwise(F.lit(0.0))).select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr",
        (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"),
    )


def keep_good(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns they came with."""
    # The row number is there to hold the filter above the verdict: pushed below it, the filter would state the
    # verdict's expressions inside each other, and compute them for every word.
    df = judged(docs, trusted_ids, **options).withColumn("row", F.monotonically_increasing_id())
    return unpacked(df.where("kept and row >= 0"), docs.columns)
