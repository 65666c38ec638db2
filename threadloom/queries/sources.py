"""Readers, fed with files that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.plans.counted_load import load_counted
from threadloom.queries import standins as st
from threadloom.queries.registry import query
from threadloom.session import scratch_path
from threadloom.sinks.tables import write_json_lines
from threadloom.sources import dumps, tables

# Epoch of a row: whole seconds as text, or with a fraction for odd ids.
EPOCH_SQL = "make_timestamp((1600000000 + {0}) * 1000000 + CASE WHEN {0} % 2 = 1 THEN 500000 ELSE 0 END)"


def _epoch(number):
    whole = (F.lit(1600000000) + number).cast("string")
    return F.when(number % 2 == 1, F.concat(whole, F.lit(".5"))).otherwise(whole)


def write_dumps(spark, sf) -> str:
    """All orders and line items as a folder with one post and one comment dump, compressed as dumps are."""
    raw = scratch_path(spark, "raw")
    posts = st.posts(spark, sf)
    number = F.col("id").cast("bigint")
    write_json_lines(
        posts.select(
            "id", "subreddit", "title", "selftext", F.floor("score").alias("score"), F.lit(3).alias("num_comments"),
            _epoch(number).alias("created_utc"),
        ),
        f"{raw}/orders_submissions", compression="gzip",
    )
    write_json_lines(
        st.comments(spark, sf).select(
            "id", "link_id", "parent_id", F.lit("someone").alias("author"), F.lit("orders").alias("subreddit"), "body",
            F.floor("score").cast("string").alias("score"), _epoch(F.col("post_id").cast("bigint")).alias("created_utc"),
        ),
        f"{raw}/orders_comments", compression="gzip",
    )
    return raw


@query("src_posts", f"""WITH {st.POSTS}
SELECT id, subreddit, coalesce(title, '') AS title, coalesce(selftext, '') AS selftext, floor(score)::BIGINT AS score,
       {EPOCH_SQL.format('id::BIGINT')} AS created_ts FROM posts""")
def src_posts(spark, sf):
    return dumps.posts(spark, f"{write_dumps(spark, sf)}/{dumps.POST_DUMPS}")


@query("src_posts_category", f"""WITH {st.POSTS}
SELECT id, subreddit, title, selftext, {EPOCH_SQL.format('id::BIGINT')} AS created_ts, floor(score)::INT AS score,
       3 AS num_comments, NULL::VARCHAR AS category FROM posts""")
def src_posts_category(spark, sf):
    return dumps.posts_with_category(spark, f"{write_dumps(spark, sf)}/{dumps.POST_DUMPS}")


@query("src_comments", f"""WITH {st.COMMENTS}
SELECT id, post_id, 'someone' AS author, coalesce(body, '') AS body, floor(score)::BIGINT AS score,
       {EPOCH_SQL.format('post_id::BIGINT')} AS created_ts FROM comments WHERE parent_id LIKE 't3_%'""")
def src_comments(spark, sf):
    return dumps.comments(spark, f"{write_dumps(spark, sf)}/{dumps.COMMENT_DUMPS}")


# French texts are cut in the middle of the record.
@query("src_tolerant_ndjson", """
SELECT doc_id::VARCHAR AS id, 'good' AS kind, text AS content FROM documents WHERE lang <> 'fr'
UNION ALL SELECT NULL, 'quarantined', '{"id": "' || doc_id::VARCHAR || '", "title": "cut' FROM documents WHERE lang = 'fr'""")
def src_tolerant_ndjson(spark, sf):
    docs = st.table(spark, sf, "documents")
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title")))
    cut = F.concat(F.lit('{"id": "'), F.col("doc_id").cast("string"), F.lit('", "title": "cut'))
    path = scratch_path(spark, "lines")
    docs.select(F.when(F.col("lang") == "fr", cut).otherwise(whole).alias("value")).write.text(path)
    good, bad = dumps.tolerant(spark, path, dumps.RAW_POST)
    return good.select("id", F.lit("good").alias("kind"), F.col("title").alias("content")).unionByName(
        bad.select(F.lit(None).cast("string").alias("id"), F.lit("quarantined").alias("kind"), F.col("line").alias("content"))
    )


def document_dumps(spark, sf) -> str:
    """Documents as post dumps, one per subreddit; turns as comments of two of them."""
    raw = scratch_path(spark, "raw")
    docs = st.raw_documents(spark, sf).withColumn("dump", F.concat("subreddit", F.lit("_submissions")))
    docs.write.partitionBy("dump").json(raw)
    turns = st.raw_turns(spark, sf).withColumn(
        "dump", F.concat(F.when(F.length("id") % 2 == 0, "keto").otherwise("paleo"), F.lit("_comments"))
    )
    turns.write.mode("append").partitionBy("dump").json(raw)
    return raw


GROUP = """CASE WHEN lower(subreddit) IN ('vegan', 'vegetarian', 'plantbaseddiet') THEN 'plantbaseddiet_combined' ELSE subreddit END"""


@query("src_file_inventory", f"""WITH {st.RAW_DOCUMENTS}, {st.RAW_TURNS},
turns AS (SELECT DISTINCT CASE WHEN length(id) % 2 = 0 THEN 'keto' ELSE 'paleo' END AS dataset FROM raw_turns)
SELECT DISTINCT subreddit AS dataset, {GROUP} AS dataset_group, subreddit IN (SELECT dataset FROM turns) AS has_comments FROM raw_documents""")
def src_file_inventory(spark, sf):
    return dumps.dataset_inventory(spark, document_dumps(spark, sf)).drop("n_post_files")


@query("src_dataset_groups", f"WITH {st.RAW_DOCUMENTS} SELECT id, subreddit AS dataset, {GROUP} AS dataset_group FROM raw_documents")
def src_dataset_groups(spark, sf):
    raw = dumps.raw_records(spark, f"{document_dumps(spark, sf)}/{dumps.POST_DUMPS}", dumps.RAW_POST)
    dataset = dumps.dataset_name(F.col("file_path"))
    return raw.select("id", dataset.alias("dataset"), dumps.dataset_group(dataset).alias("dataset_group"))


# Every seventh document's line is cut; the log counts what the write of all data sets has seen.
@query("load_log_counted", f"""WITH {st.RAW_DOCUMENTS}, c AS (
  SELECT subreddit AS dataset, count(*) FILTER (id::BIGINT % 7 <> 0) AS good, count(*) FILTER (id::BIGINT % 7 = 0) AS bad FROM raw_documents GROUP BY subreddit)
SELECT dataset, good, bad, good + bad AS read FROM c
UNION ALL SELECT '(total)', sum(good)::BIGINT, sum(bad)::BIGINT, sum(good + bad)::BIGINT FROM c""")
def load_log_counted(spark, sf):
    docs = st.raw_documents(spark, sf)
    line = F.to_json(F.struct("id", "subreddit", "title", "selftext"))
    line = F.when(F.col("id").cast("long") % 7 == 0, F.left(line, F.length(line) - 1)).otherwise(line)
    raw, store = scratch_path(spark, "raw"), scratch_path(spark, "counted")
    docs.select(F.concat("subreddit", F.lit("_submissions")).alias("dump"), line.alias("value")).write.partitionBy("dump").text(raw)
    return load_counted(spark, f"{raw}/{dumps.POST_DUMPS}", dumps.RAW_POST, store)


# French and Spanish texts are written in ISO-8859-1, the others in UTF-8.
@query("src_csv_encoding", r"""
SELECT doc_id, regexp_replace(text, '[^\x{20}-\x{7e}\x{a1}-\x{ff}]', ' ', 'g') AS comment FROM documents""")
def src_csv_encoding(spark, sf):
    options = {"quote": '"', "escape": '"', "header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    docs = st.table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", "[^\\x20-\\x7e\\u00a1-\\u00ff]", " ").alias("comment"), "lang"
    )
    raw = scratch_path(spark, "csv")
    latin = F.col("lang").isin("fr", "es")
    docs.where(~latin).drop("lang").write.options(**options).option("encoding", "UTF-8").csv(f"{raw}/a")
    docs.where(latin).drop("lang").write.options(**options).option("encoding", "ISO-8859-1").csv(f"{raw}/b")
    return tables.read_csv(spark, [f"{raw}/a", f"{raw}/b"], "doc_id long, comment string", options)


@query("src_union_by_name", """
SELECT o_orderkey AS id, o_orderstatus AS status, NULL::VARCHAR AS segment FROM orders
UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""")
def src_union_by_name(spark, sf):
    raw = scratch_path(spark, "parts")
    orders = st.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    people = st.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    write_json_lines(orders, f"{raw}/a.ndjson")
    write_json_lines(people, f"{raw}/b.ndjson")
    parts = [tables.load_table(spark, f"{raw}/{n}.ndjson", df.schema) for n, df in (("a", orders), ("b", people))]
    return tables.union_by_name(parts)


@query("src_canonical_columns", f"""WITH {st.LABELLED}
SELECT text, sentiment AS label FROM labelled UNION ALL SELECT text, role FROM conversations""")
def src_canonical_columns(spark, sf):
    new = st.labelled(spark, sf).select(F.col("text").alias("text_content"), "sentiment")
    old = st.table(spark, sf, "conversations").select(F.col("text").alias("Comment"), F.col("role").alias("Sentiment"))
    return tables.canonical_columns(new).unionByName(tables.canonical_columns(old))
