"""The test tables in the roles of posts, comments, labels and predictions.

Every DataFrame here has a SQL twin with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions.hashing import SEED, hash_bucket, hash_split
from threadloom.functions.text import words
from threadloom.sources.tables import load_table


# The test tables are files of one row group, which one task reads; whoever times work on texts sets their tasks here.
PARTITIONS: int | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents, dealt over ``PARTITIONS`` tasks if that is set."""
    return load_table(spark, f"{sf}/documents.parquet", partitions=PARTITIONS)


# -- SQL pieces ---------------------------------------------------------------

def bucket_sql(ident: str, buckets: int, seed: str | int = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {ident}), 1, 8))::BIGINT % {buckets})"


def key_sql(ident: str, seed: str | int = SEED) -> str:
    return f"(md5('{seed}:' || {ident}) || ':' || {ident})"


def split_sql(ident: str) -> str:
    b = bucket_sql(ident, 10)
    return f"CASE WHEN {b} = 0 THEN 'test' WHEN {b} = 1 THEN 'dev' ELSE 'train' END"


def pct_sql(part: str, total: str) -> str:
    return f"coalesce(((2000 * {part}::BIGINT + {total}::BIGINT) // nullif(2 * {total}::BIGINT, 0)) / 10.0::DOUBLE, 0.0::DOUBLE)"


# -- orders and lineitem as posts and comments --------------------------------

def posts(spark: SparkSession, sf: str) -> DataFrame:
    cust = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("subreddit"),
        F.when(cust % 13 != 0, F.concat(F.lit("order "), F.col("o_orderstatus"))).alias("title"),
        F.when(cust % 11 == 1, F.lit("  "))
        .when(cust % 11 != 0, F.concat(F.col("o_orderpriority"), F.lit(" by "), cust.cast("string")))
        .alias("selftext"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("created_ts"),
    )


POSTS = """posts AS (
  SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS subreddit,
         CASE WHEN o_custkey % 13 <> 0 THEN 'order ' || o_orderstatus END AS title,
         CASE WHEN o_custkey % 11 = 1 THEN '  '
              WHEN o_custkey % 11 <> 0 THEN o_orderpriority || ' by ' || o_custkey::VARCHAR END AS selftext,
         o_totalprice AS score, o_orderdate AS created_ts
  FROM orders)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey")
    order = F.col("l_orderkey").cast("string")
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        order.alias("post_id"),
        F.concat(F.lit("t3_"), order).alias("link_id"),
        F.concat(F.when(F.col("l_linenumber") > 5, "t1_").otherwise("t3_"), order).alias("parent_id"),
        F.when(part % 17 == 0, "[removed]").when(part % 17 == 1, "").when(part % 17 == 2, " \t ")
        .when(part % 17 != 3, F.concat(F.lit("part "), part.cast("string"))).alias("body"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_shipdate").alias("created_ts"),
    )


COMMENTS = """comments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey::VARCHAR AS post_id,
         't3_' || l_orderkey::VARCHAR AS link_id,
         CASE WHEN l_linenumber > 5 THEN 't1_' ELSE 't3_' END || l_orderkey::VARCHAR AS parent_id,
         CASE WHEN l_partkey % 17 = 0 THEN '[removed]' WHEN l_partkey % 17 = 1 THEN '' WHEN l_partkey % 17 = 2 THEN ' ' || chr(9) || ' '
              WHEN l_partkey % 17 <> 3 THEN 'part ' || l_partkey::VARCHAR END AS body,
         l_extendedprice AS score, l_shipdate AS created_ts
  FROM lineitem)"""

RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, created_ts, id) AS rn FROM comments)"""


# -- documents and conversations as posts and comments with prose -------------

# Subreddit names given to the twenty document sources in turn.
SUBREDDITS = ("keto", "Vegan", "intermittentfasting", "vegetarian", "paleo", "plantbaseddiet", "whole30", "KETO")


def subreddit(source: Column) -> Column:
    number = F.substring(source, 4, 10).cast("int") % len(SUBREDDITS)
    return F.element_at(F.array(*[F.lit(s) for s in SUBREDDITS]), number + 1)


SUBREDDIT = f"[{', '.join(repr(s) for s in SUBREDDITS)}][substr(source, 4)::INT % {len(SUBREDDITS)} + 1]"
TOPIC = """CASE WHEN lower(subreddit) IN ('vegan', 'vegetarian', 'plantbaseddiet') THEN 'plantbaseddiet'
  WHEN lower(subreddit) IN ('keto', 'intermittentfasting') THEN lower(subreddit) ELSE 'none' END"""


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as raw post records; every ninth has only a title."""
    doc = F.col("doc_id")
    return documents(spark, sf).select(
        doc.cast("string").alias("id"),
        subreddit(F.col("source")).alias("subreddit"),
        F.when(doc % 5 != 0, F.concat(F.lit("on "), F.col("lang"))).alias("title"),
        F.when(doc % 9 == 0, "[removed]").otherwise(F.col("text")).alias("selftext"),
        F.lit(None).cast("string").alias("body"),
        F.col("n_chars").alias("score"),
        doc.cast("string").alias("created_utc"),
    )


RAW_DOCUMENTS = f"""raw_documents AS (
  SELECT doc_id::VARCHAR AS id, {SUBREDDIT} AS subreddit,
         CASE WHEN doc_id % 5 <> 0 THEN 'on ' || lang END AS title,
         CASE WHEN doc_id % 9 = 0 THEN '[removed]' ELSE text END AS selftext,
         n_chars AS score, doc_id::VARCHAR AS created_utc
  FROM documents)"""


def raw_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as comments on the document of the same number."""
    turn = F.col("turn")
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(F.lit("t3_"), F.col("conv_id").cast("string")).alias("link_id"),
        F.when(turn % 5 == 4, "[deleted]").otherwise(F.col("text")).alias("body"),
        F.length("text").cast("bigint").alias("score"),
        F.lit("keto").alias("subreddit"),
        turn.cast("string").alias("created_utc"),
    )


RAW_TURNS = """raw_turns AS (
  SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, 't3_' || conv_id::VARCHAR AS link_id,
         CASE WHEN turn % 5 = 4 THEN '[deleted]' ELSE text END AS body,
         length(text) AS score, 'keto' AS subreddit, turn::VARCHAR AS created_utc
  FROM conversations)"""


# -- labels and predictions ---------------------------------------------------

def labelled(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, lang, source, sentiment) of the hand-labelled documents; ``docs`` are the documents as read otherwise."""
    word = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    labels = table(spark, sf, "labels").select("doc_id", word.alias("sentiment"))
    docs = documents(spark, sf) if docs is None else docs
    return docs.select("doc_id", "text", "lang", "source").join(labels, "doc_id")


LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

MODELS = ("model_a", "model_b", "model_c")
# Of ten rows, how many each stand-in model gets right for sure.
_RIGHT = {"model_a": 7, "model_b": 6, "model_c": 4}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-class labels with three made-up models and a split per row."""
    vec, label = F.col("vec_id"), F.col("label")
    cols = [
        F.when(hash_bucket(vec, buckets=10, seed=m) < right, label)
        .otherwise(hash_bucket(vec, buckets=10, seed=m + "x").cast("int")).alias(m)
        for m, right in _RIGHT.items()
    ]
    return table(spark, sf, "embeddings").select("vec_id", "label", *cols, hash_split(vec).alias("split"))


PREDICTIONS = "predictions AS (SELECT vec_id, label, " + ", ".join(
    f"CASE WHEN {bucket_sql('vec_id::VARCHAR', 10, m)} < {right} THEN label "
    f"ELSE {bucket_sql('vec_id::VARCHAR', 10, m + 'x')}::INT END AS {m}"
    for m, right in _RIGHT.items()
) + f", {split_sql('vec_id::VARCHAR')} AS split FROM embeddings)"

# -- a lexicon made from the benchmark texts -----------------------------------

# Function words of the invented prose in the roles of negators and boosters.
NEGATORS = ("de", "of", "der")
BOOSTERS = {"the": 0.293, "la": 0.293, "and": 0.293, "is": -0.293, "on": -0.293}
CONTRAST = ("with", "que")


def _digits(token: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(token), start, 4), 16, 10).cast("int")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """(token, valence): a fifth of the benchmark's words, by hash."""
    tokens = table(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("token")).distinct()
    side = _digits(F.col("token"), 1) % 10
    size = (_digits(F.col("token"), 5) % 35 + 5) / F.lit(10.0)
    return tokens.where(side < 2).select("token", F.when(side == 0, size).otherwise(-size).alias("valence"))


LEXICON = r"""lexicon AS (
  SELECT token, CASE WHEN side = 0 THEN size ELSE -size END AS valence FROM (
    SELECT token, ('0x' || substr(md5(token), 1, 4))::INT % 10 AS side,
           (('0x' || substr(md5(token), 5, 4))::INT % 35 + 5) / 10.0::DOUBLE AS size
    FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM benchmark))
  WHERE side < 2)"""
