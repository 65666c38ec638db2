"""One-scan reports, merged sketches and loads that count themselves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from threadloom.operators import profiling as pr, sketches as sk
from threadloom.plans import counted_load as cl
from threadloom.sources import dumps


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rnd = random.Random(1)
    rows = [(rnd.choice(["keto", "none", None]), rnd.choice(["positive", "negative"])) for _ in range(500)]
    path = str(tmp_path_factory.mktemp("labelled") / "rows")
    spark.createDataFrame(rows, "topic string, label string").write.parquet(path)
    return spark.read.parquet(path)


def test_the_report_reads_the_rows_once(labelled):
    report = pr.label_report(labelled, "label", "topic")
    assert plan_of(report).count("FileScan") == 1
    rows = {(r.level, r.topic, r.label): (r.n, r.pct) for r in report.collect()}
    own = labelled.collect()
    assert rows["all", None, None] == (500, 100.0)
    for topic in ("keto", "none", None):
        of_topic = [r for r in own if r.topic == topic]
        assert rows["topic", topic, None][0] == len(of_topic)
        for label in ("positive", "negative"):
            n = sum(r.label == label for r in of_topic)
            assert rows["topic and label", topic, label] == (n, pytest.approx(100 * n / len(of_topic), abs=0.051))
    assert rows["label", None, "positive"][0] + rows["label", None, "negative"][0] == 500
    assert pr.label_report(labelled.where("false"), "label", "topic").where("level <> 'all'").count() == 0


def test_merged_sketches_stay_within_their_error(spark):
    rnd = random.Random(2)
    values = [None if i % 50 == 0 else rnd.lognormvariate(3, 2) for i in range(40_000)]
    words = ["often" if i % 4 == 0 else f"w{rnd.randint(0, 3000)}" for i in range(40_000)]
    df = spark.createDataFrame(list(zip(values, words)), "value double, word string")
    loads = [sk.sketched(df.where(F.pmod(F.xxhash64("word", "value"), F.lit(5)) == i), ["value"], ["word"]) for i in range(5)]
    loads.append(sk.sketched(df.where("false"), ["value"], ["word"]))
    stored = loads[0]
    for load in loads[1:]:
        stored = stored.unionByName(load)
    profile = sk.merged(stored)
    rows = {r.column_name: r for r in sk.distinct_values(profile).collect()}
    known = [v for v in values if v is not None]
    assert rows["value"].n_rows == 40_000 and rows["value"].nulls == 800 and rows["word"].nulls == 0
    assert rows["value"].n_distinct == pytest.approx(len(set(known)), rel=0.05)
    assert rows["word"].n_distinct == pytest.approx(len(set(words)), rel=0.05)
    for r in sk.quantiles(profile, [0.05, 0.5, 0.95]).collect():
        assert sum(v <= r.value for v in known) / len(known) == pytest.approx(r.share, abs=0.02)
    first = sk.frequent_values(profile, 1).first()
    assert first.value == "often" and first.n == pytest.approx(10_000, rel=0.05)
    nothing = sk.merged(sk.sketched(df.where("false"), ["value"], ["word"]))
    assert [r.value for r in sk.quantiles(nothing, [0.5]).collect()] == [None]


def test_counts_come_with_the_write(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = {"keto": 30, "vegan": 7}
    for name, n in lines.items():
        rows = [json.dumps({"id": f"{name}{i}", "title": "t"}) for i in range(n)] + ["{cut", "", "words"][: 1 + 2 * (n > 10)]
        (raw / f"{name}_submissions").write_text("\n".join(rows))
    (raw / "README").write_text("no dump")
    store = str(tmp_path / "store")
    log = cl.load_counted(spark, str(raw / dumps.POST_DUMPS), dumps.RAW_POST, store)
    assert sorted(map(tuple, log.collect())) == [("(total)", 37, 3, 40), ("keto", 30, 2, 32), ("vegan", 7, 1, 8)]
    good, bad = cl.good(spark, store, dumps.RAW_POST), cl.quarantined(spark, store, dumps.RAW_POST)
    assert good.count() == 37 and {r.line for r in bad.collect()} == {"{cut", "words"}
    assert good.columns == [*dumps.RAW_POST.names, "file_path"]
