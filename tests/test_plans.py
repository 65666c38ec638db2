"""Physical plans: what reaches the scan, what is shuffled, what is broadcast."""

import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from threadloom import queries
from threadloom.operators import features as ft, sampling as sm, threads as th
from threadloom.queries import standins as st

SF = "/root/testdata/sf0.001"


def exchanges(plan: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|single|Round)", plan, re.I))


def test_top_children_are_cut_before_the_shuffle(spark):
    plan = plan_of(th.top_children(st.comments(spark, SF), 3))
    assert plan.count("WindowGroupLimit") == 2
    below = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_thread_texts_shuffle_each_side_once(spark):
    plan = plan_of(queries.RUNS["text_thread_join"](spark, SF))
    assert exchanges(plan) <= 2
    assert "GreaterThan(o_totalprice" in plan


def test_scans_are_pruned(spark):
    plan = plan_of(queries.RUNS["topk_per_parent"](spark, SF))
    assert "l_comment" not in plan and "l_tax" not in plan and "l_quantity" not in plan


def test_split_does_not_shuffle_the_rows(spark):
    orders = st.table(spark, SF, "orders")
    for strata in ([], ["o_orderstatus"]):
        plan = plan_of(sm.split_three(orders, ["o_orderkey"], strata))
        assert exchanges(plan) == 0 and "NestedLoop" not in plan


def test_parents_are_made_distinct_before_the_semi_join(spark):
    plan = plan_of(queries.RUNS["semi_has_children"](spark, SF))
    assert "LeftSemi" in plan and "HashAggregate" in plan


def test_partition_filter_prunes(spark):
    assert re.search(r"PartitionFilters: \[[^\]]*split", plan_of(queries.RUNS["sink_partitioned_pruned"](spark, SF)))


def test_text_stays_out_of_the_sentiment_shuffle(spark):
    plan = plan_of(queries.RUNS["sentiment_lexicon"](spark, SF))
    assert plan.count("regexp_replace") == 1  # words are cut once per text
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text" not in line


def test_scored_texts_are_not_sorted(spark):
    plan = plan_of(queries.RUNS["sentiment_class"](spark, SF))
    assert "ShuffledHashJoin" not in plan and "Sort " not in plan
    assert plan.count("FileScan") == 1 and exchanges(plan) == 1


def test_tokens_are_built_once(spark):
    docs = st.table(spark, SF, "documents").select(ft.terms(F.col("text")).alias("t"))
    assert plan_of(ft.top_terms(docs, "t", 10)).count("regexp_extract_all") == 1


# These fit models while they are built; test_queries runs them.
FITTED = {"clf_logreg", "clf_mlp", "score_with_model", "sweep_vocab", "curve_scores", "adapt_refit", "adapt_weighted"}


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - FITTED))
def test_no_python_in_queries(spark, name):
    plan = plan_of(queries.RUNS[name](spark, SF))
    assert "Python" not in plan and "InPandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_no_forbidden_checkpoint():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in [*root.glob("threadloom/**/*.py"), root / "__spark_entry__.py", root / "bench.py"]:
        assert "localCheckpoint" not in path.read_text()
