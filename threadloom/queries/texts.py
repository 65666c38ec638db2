"""Projections, filters and label maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import labels as lb, text as tx
from threadloom.functions.hashing import hash_split
from threadloom.queries import standins as st
from threadloom.queries.registry import query
from threadloom.sources.dumps import is_top_level


@query("fn_null_text", f"WITH {st.POSTS} SELECT id, coalesce(title, '') AS title, coalesce(selftext, '') AS selftext FROM posts")
def fn_null_text(spark, sf):
    return st.posts(spark, sf).select(
        "id", tx.null_text(F.col("title")).alias("title"), tx.null_text(F.col("selftext")).alias("selftext")
    )


@query("fn_strip_prefix", f"""WITH {st.COMMENTS}
SELECT id, substr(link_id, 4) AS post_id,
       CASE WHEN starts_with(parent_id, 't3_') THEN replace(parent_id, 't3_', '') ELSE parent_id END AS parent
FROM comments""")
def fn_strip_prefix(spark, sf):
    return st.comments(spark, sf).select(
        "id", tx.drop_prefix3(F.col("link_id")).alias("post_id"), tx.drop_post_prefix(F.col("parent_id")).alias("parent")
    )


# Epochs as whole and fractional text, with one that is no number.
@query("fn_epoch_ts", """
SELECT event_id, make_timestamp(round(TRY_CAST(raw AS DOUBLE) * 1e6)::BIGINT) AS created_ts FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN (1700000000 + event_id)::VARCHAR
    WHEN 1 THEN (1700000000 + event_id)::VARCHAR || '.25' WHEN 2 THEN (1700000000 + user_id)::VARCHAR || '.0' ELSE event_type END AS raw
  FROM events)""")
def fn_epoch_ts(spark, sf):
    number = (F.lit(1700000000) + F.col("event_id")).cast("string")
    by_user = (F.lit(1700000000) + F.col("user_id")).cast("string")
    case = F.col("event_id") % 4
    raw = (
        F.when(case == 0, number).when(case == 1, F.concat(number, F.lit(".25")))
        .when(case == 2, F.concat(by_user, F.lit(".0"))).otherwise(F.col("event_type"))
    )
    return st.table(spark, sf, "events").select("event_id", tx.epoch_to_timestamp(raw).alias("created_ts"))


@query("fn_casts", """
SELECT o_orderkey::VARCHAR AS id, floor(o_totalprice)::INT AS score, TRY_CAST(o_orderpriority AS INT) AS bad_number,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS good_number FROM orders""")
def fn_casts(spark, sf):
    priority = F.col("o_orderpriority")
    return st.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.floor("o_totalprice").try_cast("int").alias("score"),
        priority.try_cast("int").alias("bad_number"),
        F.substring(priority, 1, 1).try_cast("int").alias("good_number"),
    )


# Letters e of every document stand as escapes, one spelling too short to be one.
@query("fn_clean_escapes", r"""
SELECT doc_id, regexp_replace(replace(replace(text, 'e', chr(92) || 'u00e9'), 'o', chr(92) || 'u00f'),
  '\\u[0-9A-Fa-f]{4}', ' ', 'g') AS text FROM documents""")
def fn_clean_escapes(spark, sf):
    escaped = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("\\u00e9")), F.lit("o"), F.lit("\\u00f"))
    return st.table(spark, sf, "documents").select("doc_id", tx.clean_escapes(escaped).alias("text"))


@query("map_category_exact", f"""
SELECT doc_id, CASE WHEN subreddit IN ('keto', 'vegan', 'paleo', 'intermittentfasting', 'whole30') THEN subreddit END AS category
FROM (SELECT doc_id, {st.SUBREDDIT} AS subreddit FROM documents)""")
def map_category_exact(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", lb.category_of(st.subreddit(F.col("source"))).alias("category"))


@query("map_topic", f"SELECT doc_id, {st.TOPIC} AS topic FROM (SELECT doc_id, {st.SUBREDDIT} AS subreddit FROM documents)")
def map_topic(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", lb.topic_of(st.subreddit(F.col("source"))).alias("topic"))


@query("text_combined", f"""WITH {st.RAW_DOCUMENTS}
SELECT * FROM (
  SELECT id, regexp_replace(concat_ws(' ', CASE WHEN title IS NOT NULL THEN title END,
           CASE WHEN regexp_matches(selftext, '\\S') AND selftext NOT IN ('[deleted]', '[removed]') THEN selftext END),
           '^\\s+|\\s+$', '', 'g') AS text_content,
         CASE WHEN length(title) > 0 THEN 'submission' ELSE 'comment' END AS post_type
  FROM raw_documents) WHERE length(text_content) > 0""")
def text_combined(spark, sf):
    raw = st.raw_documents(spark, sf)
    text = tx.combined_text(F.col("title"), F.col("selftext"), F.col("body"))
    return raw.select("id", text.alias("text_content"), tx.record_kind(F.col("title")).alias("post_type")).where(
        F.length("text_content") > 0
    )


@query("text_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, sf):
    return st.table(spark, sf, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query("label_by_threshold", """
SELECT event_id, CASE WHEN s >= 0.05 THEN 'positive' WHEN s <= -0.05 THEN 'negative' ELSE 'neutral' END AS narrow,
       CASE WHEN s >= 0.5 THEN 'positive' WHEN s <= -0.5 THEN 'negative' ELSE 'neutral' END AS wide
FROM (SELECT event_id, (event_id % 201 - 100) / 100.0::DOUBLE AS s FROM events)""")
def label_by_threshold(spark, sf):
    score = (F.col("event_id") % 201 - 100) / F.lit(100.0)
    return st.table(spark, sf, "events").select(
        "event_id", lb.by_threshold(score).alias("narrow"), lb.by_threshold(score, 0.5, -0.5).alias("wide")
    )


@query("label_encode", f"""WITH {st.LABELLED}
SELECT doc_id, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS three_way,
       CASE sentiment WHEN 'positive' THEN 1 WHEN 'neutral' THEN 2 WHEN 'negative' THEN 3 WHEN 'offtopic' THEN 4 END AS four_way
FROM labelled WHERE lang <> 'de'""")
def label_encode(spark, sf):
    # A German text gets a label nobody knows, so its row is dropped.
    word = F.when(F.col("lang") == "de", F.lit("mixed")).otherwise(F.col("sentiment"))
    coded = st.labelled(spark, sf).select(
        "doc_id", lb.encode(word).alias("three_way"), lb.encode(word, lb.LABELS_WITH_OFFTOPIC).alias("four_way")
    )
    return coded.where(F.col("three_way").isNotNull())


@query("label_decode", """
SELECT vec_id, CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'unknown(' || label || ')' END AS word
FROM embeddings""")
def label_decode(spark, sf):
    return st.table(spark, sf, "embeddings").select("vec_id", lb.decode(F.col("label")).alias("word"))


@query("split_hash", f"SELECT o_orderkey, {st.split_sql('o_orderkey::VARCHAR')} AS split FROM orders")
def split_hash(spark, sf):
    return st.table(spark, sf, "orders").select("o_orderkey", hash_split("o_orderkey").alias("split"))


@query("flt_prefix", f"WITH {st.COMMENTS} SELECT id, parent_id FROM comments WHERE parent_id LIKE 't3_%'")
def flt_prefix(spark, sf):
    return st.comments(spark, sf).where(is_top_level(F.col("parent_id"))).select("id", "parent_id")


@query("flt_score", f"WITH {st.POSTS} SELECT id, score FROM posts WHERE score > 100000")
def flt_score(spark, sf):
    return st.posts(spark, sf).where(F.col("score") > 100000).select("id", "score")


@query("flt_not_null", f"WITH {st.POSTS} SELECT id, selftext FROM posts WHERE selftext IS NOT NULL")
def flt_not_null(spark, sf):
    return st.posts(spark, sf).where(F.col("selftext").isNotNull()).select("id", "selftext")


@query("flt_in_list", f"WITH {st.POSTS} SELECT id, subreddit FROM posts WHERE subreddit IN ('1-URGENT', '5-LOW')")
def flt_in_list(spark, sf):
    return tx.in_list(st.posts(spark, sf), "subreddit", ["1-URGENT", "5-LOW"]).select("id", "subreddit")


@query("flt_moderated", f"""WITH {st.COMMENTS}
SELECT id, body FROM comments WHERE regexp_matches(coalesce(body, ''), '\\S') AND body NOT IN ('[deleted]', '[removed]')""")
def flt_moderated(spark, sf):
    return st.comments(spark, sf).where(tx.is_kept_body(F.col("body"))).select("id", "body")
