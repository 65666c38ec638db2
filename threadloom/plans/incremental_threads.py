"""The thread export kept up to date: a load touches only the posts it brings news of.

Beside the stored posts and comments lies a table of the best comments of each
post. The best of all comments are the best of the stored best and the new ones,
so a load merges into that table and reads no stored comment again. All tables
are dealt into parts by hash of the post; parts without news are neither read nor
written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.operators.threads import thread_texts, top_children
from threadloom.session import setting, settle
from threadloom.sinks.keyed import unseen
from threadloom.sinks.tables import create_table

PARTS = 64
TASKS_PER_PART = 8
PART = "part"
NEWEST = ("created_ts", "score")


def part_of(post_id: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(post_id), F.lit(parts)).cast("int")


def stored(spark: SparkSession, path: str, schema, touched: Sequence[int]) -> DataFrame:
    """The rows of the touched parts; the other parts' folders are not opened."""
    return spark.read.schema(schema).parquet(path).where(F.col(PART).isin(list(touched)))


def replace_parts(df: DataFrame, path: str) -> None:
    """Overwrites the parts that ``df`` has rows of; the others' files stay."""
    with setting(df.sparkSession, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        df.repartition(PART).write.mode("overwrite").partitionBy(PART).option("compression", "zstd").parquet(path)


def merge_load(
    posts: DataFrame, comments: DataFrame, store: str, k: int = 3, min_score: float = 1, parts: int = PARTS,
) -> DataFrame:
    """Merges a load into the store and returns the export, ``(id, category, text)``.

    ``posts`` and ``comments`` are as ``sources.dumps`` gives them. Rows whose id
    is stored already change nothing; a load that ran half may run again. Loads
    in any cut and order give the rows of one load, as long as an id always comes
    with the same row.
    """
    spark = posts.sparkSession
    posts = posts.withColumn(PART, part_of(F.col("id"), parts))
    comments = comments.withColumn(PART, part_of(F.col("post_id"), parts))
    for name, df in (("posts", posts), ("comments", comments), ("best", comments)):
        create_table(spark, f"{store}/{name}", df.schema, PART)
    parts_of = posts.select(PART).unionByName(comments.select(PART)).where(f"{PART} IS NOT NULL").distinct()
    # At most as many as there are parts.
    touched = sorted(r[PART] for r in parts_of.collect())
    known_posts, known_comments, known_best = (
        stored(spark, f"{store}/{name}", df.schema, touched) for name, df in (("posts", posts), ("comments", comments), ("best", comments))
    )
    new_posts = settle(unseen(posts, known_posts, "id", NEWEST), "new-posts")
    new_comments = settle(unseen(comments.where("post_id IS NOT NULL"), known_comments, "id", NEWEST), "new-comments")
    # Posts and comments are stored last, so what a load that ran half has merged comes once more and is merged again.
    # Such a comment has two rows, so the best k are among the best 2 k; all is done where the post's rows meet once.
    best = top_children(known_best.unionByName(new_comments), 2 * k).drop("rn").dropDuplicates(["post_id", "id"])
    best = settle(top_children(best, k), "best")
    every_post = known_posts.unionByName(new_posts)
    texts = thread_texts(every_post.withColumnRenamed("subreddit", "category"), best, k, min_score, ranked=True)
    export = texts.withColumn(PART, part_of(F.col("id"), parts))
    create_table(spark, f"{store}/threads", export.schema, PART)
    replace_parts(best.drop("rn"), f"{store}/best")
    replace_parts(export, f"{store}/threads")
    for name, df in (("posts", new_posts), ("comments", new_comments)):
        # Several tasks to a part, for a post that a big share of the comments belongs to.
        dealt = df.repartition(PART, F.pmod(F.xxhash64("id"), F.lit(TASKS_PER_PART)))
        dealt.write.mode("append").partitionBy(PART).option("compression", "zstd").parquet(f"{store}/{name}")
    return spark.read.schema(export.schema).parquet(f"{store}/threads").drop(PART)
