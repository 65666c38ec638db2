"""Round trips through the writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.hashing import hash_bucket, hash_split
from threadloom.operators import threads as th
from threadloom.plans.incremental_threads import merge_load
from threadloom.queries import standins as st
from threadloom.queries.registry import query
from threadloom.queries.threads import LABEL_TASKS, thread_join_sql
from threadloom.session import scratch_path
from threadloom.sinks import keyed, tables as sk


# The second load brings all posts again; only unknown ids may be stored.
@query("sink_append_idempotent", f"WITH {st.POSTS} SELECT id, subreddit, score FROM posts")
def sink_append_idempotent(spark, sf):
    posts = st.posts(spark, sf).select("id", "subreddit", "score", "created_ts")
    path = scratch_path(spark, "posts")
    sk.append_new(posts.where(F.col("score") > 100000), path, "id", ["created_ts"])
    sk.append_new(posts, path, "id", ["created_ts"])
    sk.append_new(posts, path, "id", ["created_ts"])
    return spark.read.parquet(path).select("id", "subreddit", "score")


# An id that comes twice is stored once, its newest row.
STORED_THREADS = thread_join_sql(f"""{st.COMMENTS.replace('comments AS', 'loaded AS', 1)},
comments AS (SELECT * FROM loaded QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_ts DESC, score DESC) = 1)""")


def _loads(spark, sf):
    """Posts and comments in two loads; the second one brings all rows, also those of the first."""
    posts, comments = st.posts(spark, sf), st.comments(spark, sf)
    yield posts.where(hash_bucket("id", buckets=2) == 0), comments.where(hash_bucket("id", buckets=3) > 0)
    yield posts, comments


# Both tables lie by post: neither appends nor the thread join shuffle what is stored.
@query("sink_keyed_threads", STORED_THREADS)
def sink_keyed_threads(spark, sf):
    store = scratch_path(spark, "keyed")
    for posts, comments in _loads(spark, sf):
        stored_posts = keyed.append_keyed(posts, f"{store}/posts", "id", ["created_ts", "score"])
        stored_comments = keyed.append_keyed(comments, f"{store}/comments", "id", ["created_ts", "score"], within="post_id")
    return th.thread_texts(stored_posts.withColumnRenamed("subreddit", "category"), stored_comments, k=3, min_score=1000)


@query("thread_export_incremental", STORED_THREADS)
def thread_export_incremental(spark, sf):
    store = scratch_path(spark, "threads")
    for posts, comments in _loads(spark, sf):
        export = merge_load(posts, comments, store, k=3, min_score=1000)
    return export


@query("sink_replace", f"WITH {st.POSTS} SELECT id, title, selftext FROM posts")
def sink_replace(spark, sf):
    posts = st.posts(spark, sf).select("id", "title", "selftext")
    path = scratch_path(spark, "replaced")
    sk.replace_table(posts.where(F.col("title").isNull()), path)
    sk.replace_table(posts, path)
    return spark.read.parquet(path)


@query("sink_parquet_roundtrip", "SELECT doc_id, text, lang, source FROM documents")
def sink_parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "texts")
    sk.write_parquet(st.table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    return spark.read.parquet(path)


@query("sink_partitioned_pruned", f"SELECT o_orderkey, o_custkey FROM orders WHERE {st.split_sql('o_orderkey::VARCHAR')} = 'dev'")
def sink_partitioned_pruned(spark, sf):
    path = scratch_path(spark, "splits")
    orders = st.table(spark, sf, "orders").select("o_orderkey", "o_custkey", hash_split("o_orderkey").alias("split"))
    sk.write_parquet(orders, path, ["split"])
    return spark.read.parquet(path).where(F.col("split") == "dev").drop("split")


@query("sink_label_tasks", f"WITH {LABEL_TASKS} SELECT * FROM tasks")
def sink_label_tasks(spark, sf):
    path = scratch_path(spark, "tasks")
    tasks = th.label_tasks(st.posts(spark, sf), st.comments(spark, sf), k=3)
    sk.write_json_lines(tasks, path)
    return spark.read.schema(tasks.schema).json(path)


@query("audit_unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def audit_unique_key(spark, sf):
    return th.duplicate_keys(st.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("dedup_latest", """SELECT l_orderkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey""")
def dedup_latest(spark, sf):
    rows = st.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber")
    return th.latest_per_key(rows, "l_orderkey", "l_shipdate", "l_linenumber").select("l_orderkey", "l_shipdate")


@query("load_log", "SELECT 'posts' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'comments', count(*) FROM lineitem")
def load_log(spark, sf):
    tables = {"posts": st.table(spark, sf, "orders"), "comments": st.table(spark, sf, "lineitem")}
    return sk.load_log(tables).drop("ingested_at")


@query("run_summary", """
SELECT source AS dataset, count(*) AS objects, 1 AS datasets FROM documents GROUP BY source
UNION ALL SELECT '(total)', count(*), count(DISTINCT source) FROM documents""")
def run_summary(spark, sf):
    return sk.run_summary(st.table(spark, sf, "documents"), "source")
