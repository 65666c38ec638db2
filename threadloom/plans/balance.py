"""Balance posts by sentiment, attach comments, correct labels by topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions import text as tx
from threadloom.functions.hashing import SEED
from threadloom.functions.labels import SENTIMENTS, by_threshold, topic_of
from threadloom.operators.rules import DOMAIN_RULES, Rules, correct
from threadloom.operators.sampling import balanced
from threadloom.operators.sentiment import DEFAULT_SCHEME, Scheme, score_texts
from threadloom.operators.threads import attach_children
from threadloom.session import settle, small_side
from threadloom.sinks.tables import run_summary
from threadloom.sources import dumps


# Sampled rows up to which the sample is broadcast to pick its texts.
SAMPLE_ROWS = 100_000


def balance(
    raw_posts: DataFrame, lexicon: DataFrame, raw_comments: DataFrame | None = None, target: int = 1000,
    by: Sequence[str] = (), k: int = 2, comment_order: Sequence[Column] | None = None, rules: Rules = DOMAIN_RULES,
    scheme: Scheme = DEFAULT_SCHEME, high: float = 0.5, low: float = -0.5, seed: int = SEED,
) -> DataFrame:
    """The full job. ``by`` balances every group (data set) on its own; post ids are unique.

    Scores are written once, as narrow rows without text: class counts, border
    keys and the sample all read that table. Only the sampled ids go back to
    the posts for their texts. Rules come last, so the result may be off balance.
    """
    text = tx.combined_text(F.col("title"), F.col("selftext"), F.col("body"))
    usable = raw_posts.withColumn("text_content", text).where(F.length("text_content") > 0)
    scored = score_texts(usable.select("id", *by, "text_content"), "text_content", lexicon, "_compound", scheme)
    narrow = settle(
        scored.select("id", *by, by_threshold(F.col("_compound"), high, low).alias("sentiment")), "scored"
    )
    chosen = balanced(narrow, "sentiment", ["id"], target, SENTIMENTS, by, seed).select(*by, "id", "sentiment")
    sample = settle(
        usable.join(small_side(chosen, SAMPLE_ROWS), [*by, "id"]).select(
            *by, "text_content", "sentiment", "subreddit", topic_of(F.col("subreddit")).alias("topic"), "score",
            "created_utc", "id", tx.record_kind(F.col("title")).alias("post_type"),
        ),
        "sample",
    )
    if raw_comments is None:
        return correct(sample, rules=rules)
    attached = attach_children(
        sample, raw_comments, lambda df, column, out: score_texts(df, column, lexicon, out, scheme), k, comment_order,
        high, low, by, SAMPLE_ROWS,
    )
    return correct(attached, rules=rules)


def balance_dumps(
    spark: SparkSession, raw: str, out: str, lexicon: DataFrame, target: int = 1000, include_comments: bool = True,
    k: int = 2, comment_order: Sequence[Column] | None = None, rules: Rules = DOMAIN_RULES,
    scheme: Scheme = DEFAULT_SCHEME, seed: int = SEED, quarantine: str | None = None,
) -> DataFrame:
    """Balance every data set group below ``raw`` in one job.

    Writes JSON lines below ``out``, a folder per group, and returns the
    objects per group with a total line. Lines that are no records go to
    ``quarantine`` with the path of their file, if that is given. The posts are
    parsed once and settled, as scores, sample and texts all read them.
    """
    by = ["dataset_group"]
    group = dumps.dataset_group(dumps.dataset_name(F.col("file_path"))).alias(by[0])
    posts, bad = dumps.tolerant(spark, f"{raw}/{dumps.POST_DUMPS}", dumps.RAW_POST)
    posts = posts.select("*", group, F.lit(None).cast("string").alias("body"))
    comments = None
    if include_comments:
        comments, bad_comments = dumps.tolerant(spark, f"{raw}/{dumps.COMMENT_DUMPS}", dumps.RAW_COMMENT)
        comments = comments.select("*", group).withColumn("score", dumps.whole_number(F.col("score")))
        bad = bad.unionByName(bad_comments)
    if quarantine:
        bad.write.json(quarantine)
    posts = settle(posts.withColumn("score", dumps.whole_number(F.col("score"))), "posts")
    objects = balance(posts, lexicon, comments, target, by, k, comment_order, rules, scheme, seed=seed)
    objects.write.partitionBy(*by).option("ignoreNullFields", "false").json(out)
    written = spark.read.schema(objects.schema).json(out)
    return run_summary(written, by[0])
