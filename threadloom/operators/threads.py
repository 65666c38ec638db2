"""Posts with their best-ranked comments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions import text as tx
from threadloom.functions.hashing import hash_split
from threadloom.functions.labels import by_threshold, topic_of
from threadloom.session import is_small

# Order of comments in a thread: best score first, ties by age, then by id.
BEST_FIRST = (F.desc, "score"), (F.asc, "created_ts"), (F.asc, "id")


def best_first(*ties: str) -> list[Column]:
    return [F.desc("score"), *[F.asc(t) for t in ties]]


def top_children(
    comments: DataFrame, k: int, parent: str = "post_id", order: Sequence[Column] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` best comments of each parent with their rank ``rn``.

    The literal ``rn <= k`` is planned as a group limit before the shuffle, so
    a parent with very many comments sends at most k rows per input partition.
    """
    order = order or [how(name) for how, name in BEST_FIRST]
    rank = F.row_number().over(Window.partitionBy(*by, parent).orderBy(*order))
    return comments.withColumn("rn", rank).where(F.col("rn") <= k)


def children_as_columns(ranked: DataFrame, k: int, parent: str = "post_id", body: str = "body") -> DataFrame:
    """One row per parent: comment1 .. commentk."""
    return ranked.groupBy(parent).agg(
        *[F.max(F.when(F.col("rn") == i, F.col(body))).alias(f"comment{i}") for i in range(1, k + 1)]
    )


def joined_children(ranked: DataFrame, k: int, separator: str, parent: str = "post_id", body: str = "body") -> DataFrame:
    """One row per parent: its ranked comments joined in rank order."""
    wide = children_as_columns(ranked, k, parent, body)
    return wide.select(
        parent,
        # No comment with a body gives null, as an aggregate over nothing does.
        F.when(
            F.coalesce(*[f"comment{i}" for i in range(1, k + 1)]).isNotNull(),
            F.concat_ws(separator, *[F.col(f"comment{i}") for i in range(1, k + 1)]),
        ).alias("children"),
    )


def _with_children(posts: DataFrame, children: DataFrame) -> DataFrame:
    return posts.join(children, posts["id"] == children["post_id"], "left").drop("post_id")


def thread_texts(
    posts: DataFrame, comments: DataFrame, k: int = 3, min_score: float | None = 1,
    order: Sequence[Column] | None = None, ranked: bool = False,
) -> DataFrame:
    """(id, category, text): title, text and the top comments of each post.

    Comments are reduced to one row per post before the join; with ``ranked``
    they are the top ones already, with their rank ``rn``.
    """
    if min_score is not None:
        posts = posts.where(F.col("score") > min_score)
    children = joined_children(comments if ranked else top_children(comments, k, order=order), k, "\n\n")
    body = tx.thread_text(F.col("title"), F.col("selftext"), F.col("children"))
    return _with_children(posts.select("id", "category", "title", "selftext"), children).select(
        "id", "category", body.alias("text")
    )


def inline_thread_texts(
    posts: DataFrame, comments: DataFrame, k: int = 3, order: Sequence[Column] | None = None
) -> DataFrame:
    """(id, category, text, score, created_ts, split) for posts that have text."""
    children = joined_children(top_children(comments, k, order=order), k, " ")
    body = tx.thread_text_inline(F.col("title"), F.col("selftext"), F.col("children"))
    posts = posts.where(F.col("selftext").isNotNull())
    return _with_children(posts, children).select(
        "id", "category", body.alias("text"), "score", "created_ts", hash_split("id").alias("split")
    )


def label_tasks(
    posts: DataFrame, comments: DataFrame, k: int = 3, order: Sequence[Column] | None = None
) -> DataFrame:
    """One labelling task per post with empty columns for the annotator."""
    children = children_as_columns(top_children(comments, k, order=order), k)
    body = tx.label_task_text(
        F.col("title"), F.col("selftext"), [F.col(f"comment{i}") for i in range(1, k + 1)]
    )
    return _with_children(posts.select("id", "subreddit", "title", "selftext"), children).select(
        "id", "subreddit", body.alias("text"), F.lit("").alias("diet"), F.lit("").alias("sentiment")
    )


def posts_with_children(posts: DataFrame, comments: DataFrame, parent: str = "post_id") -> DataFrame:
    """Posts that have at least one comment."""
    # Distinct parents first: a hot thread shrinks to one row per task before the shuffle.
    parents = comments.select(F.col(parent).alias("id")).distinct()
    return posts.join(parents, "id", "left_semi")


def attach_children(
    posts: DataFrame,
    comments: DataFrame,
    score_text: Callable[[DataFrame, str, str], DataFrame],
    k: int = 2,
    order: Sequence[Column] | None = None,
    high: float = 0.5,
    low: float = -0.5,
    by: Sequence[str] = (),
    few_posts: int = 100_000,
) -> DataFrame:
    """Posts and their top comments as rows of the same shape.

    ``posts`` is a finished sample, so only comments of its posts are kept, and
    with ``by`` only comments of the same group. ``score_text(df, column, out)``
    adds the sentiment score; only the k kept comments of a post are scored.
    """
    keys = [*by, "link_id"]
    parents = posts.select(*by, F.concat(F.lit("t3_"), F.col("id")).alias("link_id")).distinct()
    usable = comments.where(tx.is_kept_body(F.col("body")))
    if is_small(parents, few_posts):
        kept = usable.join(F.broadcast(parents), keys, "left_semi")
        top = top_children(kept, k, "link_id", order, by)
    else:
        # Ranked first, a hot thread is cut to k rows per task before any shuffle.
        top = top_children(usable, k, "link_id", order, by).join(parents, keys, "left_semi")
    scored = score_text(top, "body", "_compound")
    rows = scored.select(
        *by,
        F.col("body").alias("text_content"),
        by_threshold(F.col("_compound"), high, low).alias("sentiment"),
        "subreddit",
        topic_of(F.col("subreddit")).alias("topic"),
        "score",
        "created_utc",
        "id",
        F.lit("comment").alias("post_type"),
        tx.drop_post_prefix(F.col("link_id")).alias("parent_id"),
    )
    return posts.withColumn("parent_id", F.lit(None).cast("string")).unionByName(rows)


def coverage(objects: DataFrame) -> DataFrame:
    """Totals of an attached sample: posts, comments, posts with comments."""
    is_comment = F.col("parent_id").isNotNull()
    # Distinct parents by a second grouping step, so no task holds them all.
    per_parent = objects.groupBy("parent_id").agg(
        F.count(F.when(is_comment, 1)).alias("_comments"), F.count(F.when(~is_comment, 1)).alias("_posts")
    )
    return per_parent.agg(
        F.coalesce(F.sum("_posts"), F.lit(0)).cast("bigint").alias("posts"),
        F.coalesce(F.sum("_comments"), F.lit(0)).cast("bigint").alias("comments_added"),
        F.count(F.when(is_comment, 1)).alias("posts_with_comments"),
        F.coalesce(F.sum(F.col("_posts") + F.col("_comments")), F.lit(0)).cast("bigint").alias("total_objects"),
    )


def latest_per_key(df: DataFrame, key: str, *newest_first: str) -> DataFrame:
    """One row per key, the newest; the policy for ids loaded twice."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in newest_first]))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
