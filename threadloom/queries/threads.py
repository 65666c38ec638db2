"""Posts joined with their best comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.labels import topic_of
from threadloom.operators import threads as th
from threadloom.operators.sentiment import Scheme, score_texts
from threadloom.queries import standins as st
from threadloom.queries.registry import query
from threadloom.session import settle


@query("topk_per_parent", f"WITH {st.COMMENTS}, {st.RANKED} SELECT post_id, id, rn FROM ranked WHERE rn <= 3")
def topk_per_parent(spark, sf):
    return th.top_children(st.comments(spark, sf), 3).select("post_id", "id", F.col("rn").cast("bigint").alias("rn"))


def thread_join_sql(comments: str) -> str:
    """Thread texts; ``comments`` are CTEs ending in ``comments``."""
    return f"""WITH {st.POSTS}, {comments}, {st.RANKED},
children AS (SELECT post_id, string_agg(body, chr(10) || chr(10) ORDER BY rn) AS children FROM ranked WHERE rn <= 3 GROUP BY post_id)
SELECT p.id, p.subreddit AS category,
       concat_ws(chr(10) || chr(10), p.title || chr(10) || p.selftext, coalesce(c.children, '')) AS text
FROM posts p LEFT JOIN children c ON p.id = c.post_id WHERE p.score > 1000"""


@query("text_thread_join", thread_join_sql(st.COMMENTS))
def text_thread_join(spark, sf):
    posts = st.posts(spark, sf).withColumnRenamed("subreddit", "category")
    return th.thread_texts(posts, st.comments(spark, sf), k=3, min_score=1000)


@query("text_thread_concat", f"""WITH {st.POSTS}, {st.COMMENTS}, {st.RANKED},
children AS (SELECT post_id, string_agg(body, ' ' ORDER BY rn) AS children FROM ranked WHERE rn <= 3 GROUP BY post_id)
SELECT p.id, p.subreddit AS category, p.title || ' ' || p.selftext || ' ' || coalesce(c.children, '') AS text, p.score,
       p.created_ts, {st.split_sql('p.id')} AS split
FROM posts p LEFT JOIN children c ON p.id = c.post_id WHERE p.selftext IS NOT NULL""")
def text_thread_concat(spark, sf):
    posts = st.posts(spark, sf).withColumnRenamed("subreddit", "category")
    return th.inline_thread_texts(posts, st.comments(spark, sf), k=3)


LABEL_TASKS = f"""{st.POSTS}, {st.COMMENTS}, {st.RANKED},
best AS (SELECT post_id, string_agg('-- Comment ' || rn || ' --' || chr(10) || trim(body, ' ' || chr(9)), chr(10) || chr(10) ORDER BY rn)
  FILTER (length(body) > 0) AS replies FROM ranked WHERE rn <= 3 GROUP BY post_id),
tasks AS (SELECT id, subreddit, concat_ws(chr(10) || chr(10), trim(nullif(title, '')), trim(nullif(selftext, '')), replies) AS text,
       '' AS diet, '' AS sentiment FROM posts LEFT JOIN best ON id = post_id)"""


@query("text_label_task", f"WITH {LABEL_TASKS} SELECT * FROM tasks")
def text_label_task(spark, sf):
    return th.label_tasks(st.posts(spark, sf), st.comments(spark, sf), k=3)


@query("thread_pivot_topk", f"""WITH {st.COMMENTS}, {st.RANKED}
SELECT o_orderkey::VARCHAR AS id, bodies[1] AS comment1, bodies[2] AS comment2, bodies[3] AS comment3
FROM orders LEFT JOIN (SELECT post_id, list(body ORDER BY rn) AS bodies FROM ranked WHERE rn <= 3 GROUP BY post_id)
  ON o_orderkey::VARCHAR = post_id""")
def thread_pivot_topk(spark, sf):
    wide = th.children_as_columns(th.top_children(st.comments(spark, sf), 3), 3)
    posts = st.posts(spark, sf).select("id")
    return posts.join(wide, posts["id"] == wide["post_id"], "left").drop("post_id")


@query("semi_has_children", f"""WITH {st.POSTS}, {st.COMMENTS}
SELECT subreddit, count(*) AS n_posts FROM posts p WHERE EXISTS (SELECT 1 FROM comments c WHERE c.post_id = p.id) GROUP BY subreddit""")
def semi_has_children(spark, sf):
    found = th.posts_with_children(st.posts(spark, sf).select("id", "subreddit"), st.comments(spark, sf))
    return found.groupBy("subreddit").agg(F.count("*").alias("n_posts"))


# All documents are the sample; conversation turns are their comments.
_SAMPLE = f"""{st.RAW_DOCUMENTS}, {st.RAW_TURNS}, {st.LEXICON},
sample AS (SELECT id, subreddit, {st.TOPIC} AS topic FROM raw_documents),
kept AS (SELECT t.*, row_number() OVER (PARTITION BY link_id ORDER BY score DESC, id) AS rn FROM raw_turns t
  WHERE regexp_matches(coalesce(body, ''), '\\S') AND body NOT IN ('[deleted]', '[removed]')
    AND link_id IN (SELECT 't3_' || id FROM sample))"""
PLAIN_SCHEME = Scheme(boosters={}, negators=(), contrast=(), capitals=0.0, exclamation=0.0, question=0.0, many_questions=0.0, phrases=None)

# Sentiment of a text without any context rule: the sum of its words' valences.
PLAIN_TOKENS = r"""SELECT {id} AS sid, CASE WHEN length(bare) > 2 THEN bare ELSE raw END AS tok FROM (
    SELECT {id}, raw, regexp_replace(raw, '^[!-/:-@\[-`{{-~]+|[!-/:-@\[-`{{-~]+$', '', 'g') AS bare
    FROM (SELECT {id}, unnest(string_split_regex(coalesce({text}, ''), '[ \t\n\r\f\v]+')) AS raw FROM {rel}) WHERE length(raw) > 0)"""


def plain_score_sql(rel: str, ident: str, text: str) -> str:
    tokens = PLAIN_TOKENS.format(id=ident, text=text, rel=rel)
    return f"""SELECT sid, sum(floor(l.valence * 1e9 + 0.5)::BIGINT)::DOUBLE / 1e9 AS s
  FROM ({tokens}) t JOIN lexicon l ON lower(t.tok) = l.token GROUP BY sid"""


COMPOUND = "round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15.0), 4)"
WIDE_CLASS = f"CASE WHEN {COMPOUND} >= 0.5 THEN 'positive' WHEN {COMPOUND} <= -0.5 THEN 'negative' ELSE 'neutral' END"


def _sample(spark, sf):
    return st.raw_documents(spark, sf).select(
        F.lit("").alias("text_content"), F.lit("neutral").alias("sentiment"), "subreddit",
        topic_of(F.col("subreddit")).alias("topic"), "score", "created_utc", "id", F.lit("submission").alias("post_type"),
    )


def _attached(spark, sf):
    words = settle(st.lexicon(spark, sf), "lexicon")
    return th.attach_children(
        _sample(spark, sf), st.raw_turns(spark, sf),
        lambda df, text, out: score_texts(df, text, words, out, PLAIN_SCHEME), k=2, order=th.best_first("id"),
    )


ATTACHED = f"""WITH {_SAMPLE}, top AS (SELECT * FROM kept WHERE rn <= 2),
sums AS ({plain_score_sql('top', 'id', 'body')}),
attached AS (
  SELECT id, subreddit, topic, 'submission' AS post_type, 'neutral' AS sentiment, NULL::VARCHAR AS parent_id, 0 AS n_chars FROM sample
  UNION ALL
  SELECT id, 'keto', 'keto', 'comment', {WIDE_CLASS}, substr(link_id, 4), length(body)
  FROM top LEFT JOIN sums ON id = sid)"""


@query("thread_attach_children", f"{ATTACHED} SELECT id, subreddit, topic, post_type, sentiment, parent_id, n_chars::BIGINT AS n_chars FROM attached")
def thread_attach_children(spark, sf):
    return _attached(spark, sf).select(
        "id", "subreddit", "topic", "post_type", "sentiment", "parent_id", F.length("text_content").cast("bigint").alias("n_chars")
    )


@query("thread_coverage", f"""{ATTACHED}
SELECT count(*) FILTER (parent_id IS NULL) AS posts, count(*) FILTER (parent_id IS NOT NULL) AS comments_added,
       count(DISTINCT parent_id) AS posts_with_comments, count(*) AS total_objects FROM attached""")
def thread_coverage(spark, sf):
    return th.coverage(_attached(spark, sf))
