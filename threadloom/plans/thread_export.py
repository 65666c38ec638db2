"""Dumps in, one training text per thread out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.threads import thread_texts
from threadloom.sinks.tables import append_new, write_parquet
from threadloom.sources import dumps


def load_dumps(spark: SparkSession, raw: str, store: str, top_level_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Append all posts and comments below ``raw`` to the Parquet store."""
    append_new(dumps.posts(spark, f"{raw}/{dumps.POST_DUMPS}"), f"{store}/posts", "id", ["created_ts", "score"])
    append_new(
        dumps.comments(spark, f"{raw}/{dumps.COMMENT_DUMPS}", top_level_only), f"{store}/comments", "id", ["created_ts", "score"]
    )
    return spark.read.parquet(f"{store}/posts"), spark.read.parquet(f"{store}/comments")


def export_threads(posts: DataFrame, comments: DataFrame, path: str, k: int = 3, min_score: float = 1) -> DataFrame:
    """Write (id, category, text) and read it back."""
    texts = thread_texts(posts.withColumnRenamed("subreddit", "category"), comments, k, min_score)
    write_parquet(texts, path)
    return posts.sparkSession.read.schema(texts.schema).parquet(path)
