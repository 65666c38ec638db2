"""Tables stored by a key, and the thread export kept up to date."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from threadloom.operators.threads import thread_texts, top_children
from threadloom.plans import incremental_threads as inc
from threadloom.sinks import keyed

POST = "id string, subreddit string, title string, selftext string, score long, created_ts long"
COMMENT = "id string, post_id string, body string, score long, created_ts long"


def made(spark, seed, posts=60, comments=900):
    """A third of the comments belong to one post; some have no id or post."""
    rnd = random.Random(seed)
    rows = [(f"p{i}", "keto", f"t{i}", None if i % 7 == 0 else f"s{i}", rnd.randint(0, 9), i) for i in range(posts)]
    said = []
    for i in range(comments):
        post = "p1" if i % 3 == 0 else f"p{rnd.randint(0, posts + 5)}"
        said.append((f"c{i}", post, f"b{i}", rnd.randint(0, 5), rnd.randint(0, 50)))
    said += [(None, "p1", "no id", 99, 1), ("c-none", None, "no post", 99, 1)]
    return spark.createDataFrame(rows, POST), spark.createDataFrame(said, COMMENT)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("buckets", [None, 8])
def test_keyed_tables_serve_threads_without_a_shuffle(spark, tmp_path, no_broadcast, buckets):
    posts, comments = made(spark, 1)
    for share in ("hash(id) % 2 = 0", "true", "true"):
        stored_posts = keyed.append_keyed(posts.where(share), str(tmp_path / "posts"), "id", ["created_ts"], buckets=buckets)
        stored = keyed.append_keyed(comments.where(share), str(tmp_path / "comments"), "id", ["created_ts"], "post_id", buckets)
    known = comments.where("id is not null and post_id is not null")
    assert rows_of(stored_posts) == rows_of(posts) and rows_of(stored) == rows_of(known)
    assert rows_of(spark.read.parquet(str(tmp_path / "comments"))) == rows_of(known)
    best, ranked = top_children(stored, 2), thread_texts(stored_posts.withColumnRenamed("subreddit", "category"), stored)
    assert "Exchange" not in plan_of(best) and "Exchange" not in plan_of(ranked)
    assert rows_of(best) == rows_of(top_children(known, 2))
    assert rows_of(ranked) == rows_of(thread_texts(posts.withColumnRenamed("subreddit", "category"), known))


def test_appends_leave_stored_rows_where_they_are(spark, tmp_path, no_broadcast):
    _, comments = made(spark, 2)
    path = str(tmp_path / "comments")
    stored = keyed.append_keyed(comments, path, "id", ["created_ts"], "post_id")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "comments").glob("part-*")}
    with keyed.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        plan = plan_of(keyed.unseen(comments, stored, "id", ["created_ts"], "post_id"))
    # The new rows are dealt out for the join and once more to find the newest of an id; the stored ones are read as they lie.
    left, right = plan.split("LeftAnti")[1].split("FileScan parquet")[0], plan.split("FileScan parquet")[1]
    assert left.count("Exchange") == 1 and "Bucketed: true" in right
    assert plan.split("LeftAnti")[0].count("Exchange") == 1
    n = stored.count()
    more = spark.createDataFrame([("new", "p1", "b", 1, 1)], COMMENT)
    assert keyed.append_keyed(more, path, "id", ["created_ts"], "post_id").count() == n + 1
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())


def test_a_hot_post_shows_in_the_shares(spark, tmp_path):
    rows = [(f"c{i}", "hot" if i % 3 else f"p{i}", "x" * (i % 97) + str(i), i, i) for i in range(30_000)]
    keyed.append_keyed(spark.createDataFrame(rows, COMMENT), str(tmp_path / "c"), "id", ["created_ts"], "post_id", buckets=16)
    shares = {r.bucket: r.share for r in keyed.bucket_shares(spark, str(tmp_path / "c")).collect()}
    assert len(shares) == 16 and sum(shares.values()) == pytest.approx(1) and max(shares.values()) > 0.4


@pytest.mark.parametrize("seed", [3, 4])
def test_two_loads_give_the_rows_of_one(spark, tmp_path, seed):
    posts, comments = made(spark, seed)
    whole = rows_of(inc.merge_load(posts, comments, str(tmp_path / "one"), parts=8))
    cuts = [("hash(id) % 3 = 0", "hash(body) % 2 = 0"), ("true", "hash(body) % 2 <> 0"), ("false", "true"), ("true", "true")]
    for mine, theirs in cuts:
        export = inc.merge_load(posts.where(mine), comments.where(theirs), str(tmp_path / "two"), parts=8)
    assert rows_of(export) == whole
    expected = thread_texts(posts.withColumnRenamed("subreddit", "category"), comments.where("id is not null"), 3, 1)
    assert whole == rows_of(expected)
    for name in ("posts", "comments"):
        a, b = (spark.read.parquet(str(tmp_path / store / name)) for store in ("one", "two"))
        assert rows_of(a.select(sorted(a.columns))) == rows_of(b.select(sorted(b.columns)))


def test_parts_without_news_are_not_written(spark, tmp_path):
    posts, comments = made(spark, 5)
    inc.merge_load(posts, comments, str(tmp_path), parts=8)

    def files():
        return {p: p.stat().st_mtime_ns for name in ("best", "threads", "posts", "comments") for p in (tmp_path / name).glob("part=*/part-*")}

    before = files()
    news = spark.createDataFrame([("late", "p5", "the best of all", 99, 1)], COMMENT)
    export = inc.merge_load(posts.where("false"), news, str(tmp_path), parts=8)
    part = spark.range(1).select(inc.part_of(F.lit("p5"), 8)).first()[0]
    after = files()
    gone = {p for p in before if after.get(p) != before[p]}
    assert gone and all(f"part={part}" in str(p) for p in gone | (set(after) - set(before)))
    assert not any("/posts/" in str(p) or "/comments/" in str(p) for p in gone)
    shown = export.where("id = 'p5'").first()
    assert shown is None or "the best of all" in shown.text
    inc.merge_load(posts.where("false"), comments.where("false"), str(tmp_path), parts=8)
    assert files() == after


def test_a_load_that_ran_half_runs_again(spark, tmp_path, monkeypatch):
    posts, comments = made(spark, 6)
    done = []
    keep = inc.replace_parts

    def once(df, path):
        keep(df, path)
        done.append(path)
        if len(done) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(inc, "replace_parts", once)
    with pytest.raises(RuntimeError):
        inc.merge_load(posts, comments, str(tmp_path / "a"), parts=8)
    again = inc.merge_load(posts, comments, str(tmp_path / "a"), parts=8)
    assert rows_of(again) == rows_of(inc.merge_load(posts, comments, str(tmp_path / "b"), parts=8))


def test_a_load_ranks_its_comments_once(spark, tmp_path, no_broadcast, monkeypatch):
    posts, comments = made(spark, 7)
    plans, settle, replace = {}, inc.settle, inc.replace_parts
    monkeypatch.setattr(inc, "settle", lambda df, name: plans.update({name: plan_of(df)}) or settle(df, name))
    monkeypatch.setattr(inc, "replace_parts", lambda df, path: plans.update({path[-7:]: plan_of(df)}) or replace(df, path))
    for _ in range(2):
        inc.merge_load(posts, comments, str(tmp_path), parts=8)
        assert plans["best"].count("Exchange hashpartitioning") == 1 and "Window" not in plans["threads"]
        assert "touched-posts" not in plans
