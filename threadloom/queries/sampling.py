"""Samples, splits, folds and nested subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import sampling as sm
from threadloom.operators.models import weighted_union
from threadloom.operators.profiling import distribution
from threadloom.queries import standins as st
from threadloom.queries.registry import query

KEY = st.key_sql("doc_id::VARCHAR")
BY_CLASS = f"""{st.LABELLED}, placed AS (SELECT doc_id, sentiment, lang,
  row_number() OVER (PARTITION BY sentiment ORDER BY {KEY}) AS rk, count(*) OVER (PARTITION BY sentiment) AS n FROM labelled)"""
OVERALL = f"""placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY {st.key_sql('o_orderkey::VARCHAR')}) AS rk, count(*) OVER () AS n FROM orders)"""


def _rows(spark, sf):
    return st.labelled(spark, sf).select("doc_id", "sentiment", "lang")


@query("sample_n", f"SELECT doc_id, source FROM documents ORDER BY {KEY} LIMIT 300")
def sample_n(spark, sf):
    return sm.random_rows(st.table(spark, sf, "documents").select("doc_id", "source"), 300, ["doc_id"])


@query("shuffle_order", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {st.key_sql('o_orderkey::VARCHAR')}")
def shuffle_order(spark, sf):
    return sm.shuffled(st.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("shuffle_head", f"WITH {st.LABELLED} SELECT doc_id, sentiment FROM labelled ORDER BY {KEY} LIMIT 100")
def shuffle_head(spark, sf):
    return sm.shuffled(_rows(spark, sf).drop("lang"), ["doc_id"], limit=100)


@query("sample_balanced", f"""WITH {BY_CLASS} SELECT doc_id, sentiment FROM placed
WHERE rk <= least(40, (SELECT min(n) FROM placed)) AND (SELECT count(DISTINCT sentiment) FROM placed) = 3""")
def sample_balanced(spark, sf):
    return sm.balanced(_rows(spark, sf), "sentiment", ["doc_id"], target=40).select("doc_id", "sentiment")


@query("sample_equal_strata", f"WITH {BY_CLASS} SELECT doc_id, sentiment FROM placed WHERE rk <= (SELECT min(n) FROM placed)")
def sample_equal_strata(spark, sf):
    return sm.balanced(_rows(spark, sf), "sentiment", ["doc_id"], None, None).select("doc_id", "sentiment")


# Documents in German count as off-topic here.
@query("sample_capped", f"""WITH {st.LABELLED}, words AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN 'offtopic' ELSE sentiment END AS label FROM labelled),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rk FROM words)
SELECT doc_id, label FROM placed WHERE label IN ('negative', 'offtopic') OR rk <= CASE label WHEN 'positive' THEN 70 ELSE 100 END""")
def sample_capped(spark, sf):
    label = F.when(F.col("lang") == "de", "offtopic").otherwise(F.col("sentiment"))
    rows = _rows(spark, sf).select("doc_id", label.alias("label"))
    return sm.capped(rows, "label", {"positive": 70, "neutral": 100}, ["negative", "offtopic"], [F.col("doc_id")])


@query("split_random", f"WITH {OVERALL} SELECT o_orderkey, CASE WHEN rk <= (n + 4) // 5 THEN 'test' ELSE 'train' END AS split FROM placed")
def split_random(spark, sf):
    return sm.split_two(st.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "0.2")


SPLIT_THREE = f"""{BY_CLASS}, splits AS (SELECT doc_id, sentiment, CASE WHEN rk <= (n + 4) // 5 THEN 'test'
  WHEN rk <= (n + 4) // 5 + (n - (n + 4) // 5 + 3) // 4 THEN 'val' ELSE 'train' END AS split FROM placed)"""


def _split_three(spark, sf):
    return sm.split_three(_rows(spark, sf), ["doc_id"], ["sentiment"])


@query("split_stratified", f"WITH {SPLIT_THREE} SELECT * FROM splits")
def split_stratified(spark, sf):
    return _split_three(spark, sf).select("doc_id", "sentiment", "split")


@query("split_stratified_2way", f"WITH {BY_CLASS} SELECT doc_id, sentiment, CASE WHEN rk <= (3 * n + 9) // 10 THEN 'val' ELSE 'train' END AS split FROM placed")
def split_stratified_2way(spark, sf):
    split = sm.split_two(_rows(spark, sf), ["doc_id"], "0.3", ["sentiment"], names=("train", "val"))
    return split.select("doc_id", "sentiment", "split")


@query("split_report", f"""WITH {SPLIT_THREE}, c AS (SELECT split, count(*) AS n FROM splits GROUP BY split)
SELECT split, n, {st.pct_sql('n', '(sum(n) OVER ())')} AS pct FROM c""")
def split_report(spark, sf):
    return distribution(_split_three(spark, sf), "split")


TENTHS = sm.fraction_steps("1/10", "1", 10)


@query("curve_subsets", f"""WITH {OVERALL}, steps AS (SELECT unnest(range(1, 11)) AS step)
SELECT o_orderkey, step / 10.0::DOUBLE AS fraction FROM placed JOIN steps ON rk <= (n * step) // 10""")
def curve_subsets(spark, sf):
    return sm.nested_fractions(st.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], TENTHS)


@query("folds_stratified", f"""WITH {BY_CLASS}, f AS (SELECT doc_id, sentiment, unnest(range(0, 5)) AS fold, rk, n FROM placed)
SELECT doc_id, sentiment, fold::INT AS fold FROM f WHERE rk > (n * fold) // 5 AND rk <= (n * (fold + 1)) // 5""")
def folds_stratified(spark, sf):
    return sm.folds(_rows(spark, sf), ["doc_id"], 5, ["sentiment"]).select("doc_id", "sentiment", "fold")


# English texts are the general domain, all others the target domain.
@query("train_weighted_union", f"""WITH {st.LABELLED}
SELECT doc_id, sentiment, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM labelled""")
def train_weighted_union(spark, sf):
    rows = _rows(spark, sf)
    both = weighted_union(rows.where(F.col("lang") == "en"), rows.where(F.col("lang") != "en"))
    return both.select("doc_id", "sentiment", "weight")
