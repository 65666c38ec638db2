import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions.hashing import order_key
from threadloom.operators import sampling as sm
from threadloom.operators.ranking import segment_by_rank, share_up


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest() + f":{i}"


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds most rows, one a handful."""
    rng = random.Random(1)
    rows = [(i, rng.choices(["positive", "negative", "neutral"], [90, 9, 1])[0]) for i in range(5000)]
    return rows, spark.createDataFrame(rows, "id long, label string").repartition(7).persist()


def test_balanced_takes_the_same_number_of_each_class(skewed):
    rows, df = skewed
    smallest = min(Counter(c for _, c in rows).values())
    for target, expected in ((20, 20), (10**9, smallest)):
        got = sm.balanced(df, "label", ["id"], target).collect()
        assert Counter(r["label"] for r in got) == dict.fromkeys(("positive", "negative", "neutral"), expected)
        for label in ("positive", "negative", "neutral"):
            best = sorted((i for i, c in rows if c == label), key=key)[:expected]
            assert sorted(best) == sorted(r["id"] for r in got if r["label"] == label)


def test_a_missing_class_gives_no_rows_but_the_schema(spark):
    df = spark.createDataFrame([(1, "positive"), (2, "negative")], "id long, label string")
    out = sm.balanced(df, "label", ["id"])
    assert out.count() == 0 and out.columns == ["id", "label"]


def test_groups_are_balanced_on_their_own(spark):
    rows = [(i, f"g{i % 2}", ("positive", "negative", "neutral")[i % 3] if i % 2 else "positive") for i in range(300)]
    out = sm.balanced(spark.createDataFrame(rows, "id long, g string, label string"), "label", ["id"], 10, by=["g"]).collect()
    assert Counter((r["g"], r["label"]) for r in out) == {("g1", c): 10 for c in ("positive", "negative", "neutral")}


def test_splits_are_disjoint_exact_and_reproducible(skewed):
    rows, df = skewed
    out = sm.split_three(df, ["id"], ["label"]).collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _ in rows)
    for label, n in Counter(c for _, c in rows).items():
        sizes = Counter(r["split"] for r in out if r["label"] == label)
        test = -(-n // 5)
        assert (sizes["test"], sizes["val"]) == (test, -(-(n - test) // 4))
    again = {r["id"]: r["split"] for r in sm.split_three(df.repartition(3), ["id"], ["label"]).collect()}
    assert again == {r["id"]: r["split"] for r in out}


def test_short_prefixes_give_the_same_borders(skewed):
    _, df = skewed
    cuts = [("a", share_up("0.3")), ("b", share_up("0.31"))]
    parts = [
        {r["id"]: r["segment"] for r in segment_by_rank(df, order_key("id"), cuts, "c", prefix_digits=d).collect()} for d in (1, 2, 4)
    ]
    assert parts[0] == parts[1] == parts[2]
    assert Counter(parts[0].values()) == {"a": 1500, "b": 50, "c": 3450}


def test_null_strata_are_a_stratum(spark):
    rows = [(i, None if i % 2 else "x") for i in range(100)]
    out = sm.split_two(spark.createDataFrame(rows, "id long, s string"), ["id"], "0.1", ["s"]).collect()
    assert Counter((r["s"], r["split"]) for r in out) == {("x", "test"): 5, ("x", "train"): 45, (None, "test"): 5, (None, "train"): 45}


def test_folds_differ_by_one_at_most(skewed):
    rows, df = skewed
    out = sm.folds(df, ["id"], 5, ["label"]).collect()
    for label in Counter(c for _, c in rows):
        sizes = Counter(r["fold"] for r in out if r["label"] == label).values()
        assert max(sizes) - min(sizes) <= 1
    assert len(out) == len(rows)


def test_fractions_are_nested(skewed):
    rows, df = skewed
    steps = sm.fraction_steps("1/5", "1", 8)
    subsets = {}
    for r in sm.nested_fractions(df, ["id"], steps).collect():
        subsets.setdefault(r["fraction"], set()).add(r["id"])
    ordered = [subsets[f] for f in sorted(subsets)]
    assert len(ordered) == 8 and all(a < b for a, b in zip(ordered, ordered[1:]))
    assert len(ordered[0]) == 1000 and len(ordered[-1]) == 5000


def test_capped_keeps_input_order_and_uncapped_classes(skewed):
    rows, df = skewed
    out = sm.capped(df, "label", {"positive": 70, "neutral": 10}, ["negative"], [F.col("id")]).collect()
    for label, cap in (("positive", 70), ("neutral", 10), ("negative", None)):
        expected = sorted(i for i, c in rows if c == label)[:cap]
        assert sorted(r["id"] for r in out if r["label"] == label) == expected


def test_big_buckets_are_divided(skewed):
    _, df = skewed
    cuts = [("a", share_up("0.3")), ("b", share_up("0.31")), ("c", share_up("0.9"))]
    plain, divided = (
        {r["id"]: r["segment"] for r in segment_by_rank(df, order_key("id"), cuts, "d", ["label"], bucket_rows=n, prefix_digits=1).collect()}
        for n in (10**6, 3)
    )
    assert plain == divided and set(plain.values()) == {"a", "b", "c", "d"}


@pytest.mark.parametrize("n", [0, 1, 7, 300, 999, 1000, 5000])
def test_a_big_sample_is_the_head_of_the_same_order(spark, n):
    df = spark.range(1000).withColumn("x", F.col("id") % 3)
    small = [tuple(r) for r in sm.shuffled(df, ["id"], limit=n).collect()]
    assert [tuple(r) for r in sm.shuffled(df, ["id"], limit=n, page=-1).collect()] == small
    assert sorted(map(tuple, sm.random_rows(df, n, ["id"], page=-1).collect())) == sorted(small) and len(small) == min(n, 1000)
