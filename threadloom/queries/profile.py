"""Counts, distributions and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.labels import SENTIMENTS, topic_of
from threadloom.operators import profiling as pr, sketches as sk
from threadloom.queries import standins as st
from threadloom.queries.registry import query
from threadloom.session import settle

TOPICS = f"""topics AS (SELECT doc_id, sentiment, {st.TOPIC} AS topic FROM (
  SELECT doc_id, sentiment, {st.SUBREDDIT} AS subreddit FROM labelled))"""


def topics(spark, sf):
    return st.labelled(spark, sf).select("doc_id", "sentiment", topic_of(st.subreddit(F.col("source"))).alias("topic"))


@query("class_min", f"""WITH {st.LABELLED}, n AS (SELECT count(*) FILTER (sentiment = 'positive') AS n_positive,
  count(*) FILTER (sentiment = 'negative') AS n_negative, count(*) FILTER (sentiment = 'neutral') AS n_neutral FROM labelled)
SELECT *, least(n_positive, n_negative, n_neutral) AS min_n FROM n""")
def class_min(spark, sf):
    return pr.smallest_class(st.labelled(spark, sf), "sentiment", SENTIMENTS)


@query("dist_class", f"""WITH {st.LABELLED}, c AS (SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment)
SELECT sentiment, n, {st.pct_sql('n', '(sum(n) OVER ())')} AS pct FROM c""")
def dist_class(spark, sf):
    return pr.distribution(st.labelled(spark, sf), "sentiment")


@query("dist_topic", f"""WITH c AS (SELECT {st.TOPIC} AS topic, count(*) AS n FROM (SELECT {st.SUBREDDIT} AS subreddit FROM documents) GROUP BY 1)
SELECT topic, n, {st.pct_sql('n', '(sum(n) OVER ())')} AS pct FROM c""")
def dist_topic(spark, sf):
    docs = st.table(spark, sf, "documents").select(topic_of(st.subreddit(F.col("source"))).alias("topic"))
    return pr.distribution(docs, "topic")


CROSSTAB = f"""WITH {st.LABELLED}, {TOPICS}, x AS (SELECT topic, count(*) FILTER (sentiment = 'positive') AS positive,
  count(*) FILTER (sentiment = 'negative') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM topics GROUP BY topic)"""


@query("crosstab_counts", f"{CROSSTAB} SELECT * FROM x ORDER BY topic")
def crosstab_counts(spark, sf):
    return pr.crosstab(topics(spark, sf), "topic", "sentiment", SENTIMENTS).orderBy("topic")


@query("crosstab_pct", f"""{CROSSTAB} SELECT topic, {st.pct_sql('positive', '(positive + negative + neutral)')} AS positive,
  {st.pct_sql('negative', '(positive + negative + neutral)')} AS negative,
  {st.pct_sql('neutral', '(positive + negative + neutral)')} AS neutral FROM x""")
def crosstab_pct(spark, sf):
    return pr.crosstab_percent(topics(spark, sf), "topic", "sentiment", SENTIMENTS)


@query("describe_numeric", """
SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events""")
def describe_numeric(spark, sf):
    out = pr.describe(st.table(spark, sf, "events"), "value")
    return out.select("count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


PROFILED = ("id", "subreddit", "title", "selftext", "score", "created_ts")


@query("profile_table", f"WITH {st.POSTS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS n_rows, 6 AS n_columns FROM posts" for c in PROFILED))
def profile_table(spark, sf):
    return pr.table_profile(st.posts(spark, sf))


@query("label_report", f"""WITH {st.LABELLED}, {TOPICS}, c AS (
  SELECT topic, sentiment, grouping(topic) AS no_topic, grouping(sentiment) AS no_label, count(*) AS n FROM topics
  GROUP BY GROUPING SETS ((), (sentiment), (topic), (topic, sentiment))),
w AS (SELECT *, CASE WHEN no_topic = 0 AND no_label = 0 THEN max(n) FILTER (no_label = 1) OVER (PARTITION BY topic, no_topic)
  ELSE max(n) FILTER (no_topic = 1 AND no_label = 1) OVER () END AS whole FROM c)
SELECT CASE WHEN no_topic = 0 AND no_label = 0 THEN 'topic and label' WHEN no_topic = 0 THEN 'topic' WHEN no_label = 0 THEN 'label' ELSE 'all' END AS level,
       topic, sentiment AS label, n, {st.pct_sql('n', 'whole')} AS pct FROM w""")
def label_report(spark, sf):
    return pr.label_report(topics(spark, sf), "sentiment", "topic")


def _event_loads(spark, sf):
    """The profiles of the events in four loads, stored, then merged; the events themselves are read once each."""
    events = st.table(spark, sf, "events")
    loads = None
    for i in range(4):
        own = sk.sketched(events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i), ["value"], ["event_type"])
        loads = own if loads is None else loads.unionByName(own)
    return sk.merged(settle(loads, "profiles"))


# Estimates show as the exact value where they are within their error: five percent of a number of distinct values or a
# count of a frequent value, two percent of the rows for the rank of a quantile.
@query("profile_sketches", """
SELECT 'distinct' AS kind, 'event_type' AS item, count(DISTINCT event_type)::DOUBLE AS amount FROM events
UNION ALL SELECT 'distinct', 'value', count(DISTINCT value) FROM events
UNION ALL SELECT 'frequent', event_type, count(*) FROM events GROUP BY event_type
UNION ALL SELECT 'rank', share::VARCHAR, share FROM (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS share)""")
def profile_sketches(spark, sf):
    events, profile = st.table(spark, sf, "events"), _event_loads(spark, sf)

    def shown(estimate, exact, bound):
        return F.when(F.abs(estimate - exact) <= bound, exact).otherwise(estimate).cast("double").alias("amount")

    exact = events.agg(F.count_distinct("event_type").alias("event_type"), F.count_distinct("value").alias("value"))
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("exact")) for c in ("event_type", "value")])))
    distinct = sk.distinct_values(profile).join(exact, "column_name").select(
        F.lit("distinct").alias("kind"), F.col("column_name").alias("item"), shown(F.col("n_distinct"), F.col("exact"), 0.05 * F.col("exact"))
    )
    counts = events.groupBy(F.col("event_type").cast("string").alias("value")).agg(F.count("*").alias("exact"))
    frequent = sk.frequent_values(profile, 100).join(counts, "value").select(
        F.lit("frequent").alias("kind"), F.col("value").alias("item"), shown(F.col("n"), F.col("exact"), 0.05 * F.col("exact"))
    )
    # At most five values.
    near = sk.quantiles(profile, [0.1, 0.25, 0.5, 0.75, 0.9]).collect()
    ranks = events.agg(*[F.avg(F.when(F.col("value") <= r["value"], 1.0).otherwise(0.0)).alias(str(r["share"])) for r in near])
    ranks = ranks.select(F.inline(F.array(*[F.struct(F.lit(r["share"]).alias("share"), F.col(f"`{r['share']}`").alias("rank")) for r in near])))
    return distinct.unionByName(frequent).unionByName(
        ranks.select(F.lit("rank").alias("kind"), F.col("share").cast("string").alias("item"), shown(F.col("rank"), F.col("share"), F.lit(0.02)))
    )
