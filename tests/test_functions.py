import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.functions import annotations as an, labels as lb, text as tx


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_prefixes(spark):
    rows = [("t3_x",), ("t1_x",), ("t3x",), ("t3_t3_x",), (None,)]
    out = values(spark, rows, "c string", tx.drop_prefix3(F.col("c")), tx.drop_post_prefix(F.col("c")))
    assert out == [("x", "x"), ("x", "t1_x"), ("", "t3x"), ("t3_x", "x"), (None, None)]


def test_prefix_filter_treats_underscore_as_any_character(spark):
    from threadloom.sources.dumps import is_top_level

    rows = [("t3_x",), ("t3xx",), ("t3",), ("t1_x",)]
    assert [r[0] for r in values(spark, rows, "c string", is_top_level(F.col("c")))] == [True, True, False, False]


def test_epochs(spark):
    rows = [("1700000000",), ("1700000000.25",), ("junk",), (None,), ("1e9",)]
    day = dt.datetime(2023, 11, 14, 22, 13, 20)
    out = [r[0] for r in values(spark, rows, "c string", tx.epoch_to_timestamp(F.col("c")))]
    assert out == [day, day + dt.timedelta(microseconds=250000), None, None, dt.datetime(2001, 9, 9, 1, 46, 40)]


def test_white_space_is_stripped_like_unicode(spark):
    text = "  \t a b 　\n"
    assert values(spark, [(text,)], "c string", tx.strip_space(F.col("c"))) == [("a b",)]


def test_escapes(spark):
    slash = chr(92)
    rows = [(f"caf{slash}u00e9 {slash}u12 {slash}uABCDx",), (None,)]
    assert values(spark, rows, "c string", tx.clean_escapes(F.col("c"))) == [(f"caf  {slash}u12  x",), (None,)]


@pytest.mark.parametrize(
    "title, selftext, body, expected",
    [
        ("T", "s", None, "T s"), ("T", "[removed]", None, "T"), ("[deleted]", "[deleted]", "b", "[deleted] b"),
        (" \t", "", None, ""), (None, None, " b ", "b"), ("T", "  ", "[deleted]", "T"),
    ],
)
def test_combined_text(spark, title, selftext, body, expected):
    df = spark.createDataFrame([(title, selftext, body)], "t string, s string, b string")
    assert df.select(tx.combined_text(F.col("t"), F.col("s"), F.col("b"))).first()[0] == expected


def test_thread_texts_at_the_edges(spark):
    rows = [("t", "s", "c"), ("t", "s", None), (None, "s", "c"), (None, "s", None)]
    cols = [F.col(c) for c in "tsc"]
    out = values(spark, rows, "t string, s string, c string", tx.thread_text(*cols), tx.thread_text_inline(*cols))
    assert out == [("t\ns\n\nc", "t s c"), ("t\ns\n\n", "t s "), ("c", None), ("", None)]


def test_label_task_text_keeps_the_rank_numbers(spark):
    df = spark.createDataFrame([(" T ", None, "a ", "", "c")], "t string, s string, c1 string, c2 string, c3 string")
    text = tx.label_task_text(F.col("t"), F.col("s"), [F.col("c1"), F.col("c2"), F.col("c3")])
    assert df.select(text).first()[0] == "T\n\n-- Comment 1 --\na\n\n-- Comment 3 --\nc"


def test_thresholds_belong_to_the_outer_classes(spark):
    rows = [(0.05,), (-0.05,), (0.0499,), (0.5,), (None,)]
    out = values(spark, rows, "s double", lb.by_threshold(F.col("s")), lb.by_threshold(F.col("s"), 0.5, -0.5))
    assert out == [("positive", "neutral"), ("negative", "neutral"), ("neutral", "neutral"), ("positive", "positive"), ("neutral", "neutral")]


def test_topics_and_categories(spark):
    rows = [("KETO",), ("Vegan",), ("vegetarian",), ("intermittentfasting",), ("paleo",), (None,), ("",)]
    out = values(spark, rows, "s string", lb.topic_of(F.col("s")), lb.category_of(F.col("s")))
    assert out == [
        ("keto", None), ("plantbaseddiet", None), ("plantbaseddiet", None), ("intermittentfasting", "intermittentfasting"),
        ("none", "paleo"), ("none", None), ("none", None),
    ]


def test_percent_rounds_half_up_and_survives_an_empty_total(spark):
    rows = [(1, 8), (1, 3), (0, 0), (1, 2000), (5, 5)]
    assert [r[0] for r in values(spark, rows, "a long, b long", lb.percent(F.col("a"), F.col("b")))] == [12.5, 33.3, 0.0, 0.1, 100.0]


def test_codes(spark):
    rows = [("positive",), ("offtopic",), ("odd",)]
    out = values(spark, rows, "s string", lb.encode(F.col("s")), lb.encode(F.col("s"), lb.LABELS_WITH_OFFTOPIC))
    assert out == [(2, 1), (None, 4), (None, None)]
    assert [r[0] for r in values(spark, [(0,), (7,)], "i int", lb.decode(F.col("i")))] == ["negative", "unknown(7)"]


def result(name="sentiment", kind="choices", choices=("positive",)):
    return {"from_name": name, "type": kind, "value": None if choices is None else {"choices": list(choices)}}


@pytest.mark.parametrize(
    "annotations, strict, first, valid",
    [
        (None, None, None, False),
        ([], None, None, False),
        ([{"result": None}], None, None, False),
        ([{"result": []}, {"result": [result()]}], None, "positive", True),
        ([{"result": [result(choices=("odd",))]}, {"result": [result()]}], "odd", "odd", True),
        ([{"result": [result(choices=("neutral", "positive"))]}], "neutral", "neutral", True),
        ([{"result": [result("diet"), result(kind="labels")]}], None, "positive", True),
        ([{"result": [result(choices=None), result(choices=())]}], None, None, False),
        ([{"result": [result(choices=("off-topic",))]}], "off-topic", "off-topic", True),
        ([{"result": [result(choices=("odd",))]}], "odd", "odd", False),
    ],
)
def test_annotations(spark, annotations, strict, first, valid):
    df = spark.createDataFrame([(1, {"text": "x"}, annotations)], an.TASK_SCHEMA)
    a = F.col("annotations")
    assert tuple(df.select(an.strict_label(a), an.first_label(a), an.has_valid_label(a)).first()) == (strict, first, valid)
