import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from threadloom.functions.annotations import TASK_SCHEMA
from threadloom.plans.thread_export import export_threads, load_dumps
from threadloom.sinks import tables as sk
from threadloom.sources import dumps, tables, tasks
from threadloom.sources.arrays import array_records
from threadloom.streaming.incremental import score_new_files

POSTS = [
    {"id": "a", "subreddit": "keto", "title": "T", "selftext": None, "score": 5, "created_utc": "1700000000"},
    {"id": "b", "subreddit": "vegan", "title": "U", "selftext": "x", "score": "7", "created_utc": 1700000000.5, "num_comments": 2},
    {"id": "c", "subreddit": "x", "title": "V", "selftext": "y", "score": 1, "created_utc": 1},
]
COMMENTS = [
    {"id": f"c{i}", "link_id": "t3_a", "parent_id": parent, "body": f"body {i}", "score": i, "created_utc": i}
    for i, parent in enumerate(["t3_a", "t1_zz", "t3_a", "t3_a", "t3_a"])
]


def write(path, rows, bad=()):
    data = "\n".join([*(json.dumps(r) for r in rows), *bad]).encode()
    path.write_bytes(zstandard.compress(data) if path.suffix == ".zst" else data)


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    write(folder / "keto_submissions.zst", POSTS[:2], bad=["{broken", "", "plain words"])
    write(folder / "vegan_submissions", POSTS[2:])
    write(folder / "keto_comments.zst", COMMENTS)
    (folder / "README").write_text("not a dump")
    return folder


def test_compressed_dumps_load_and_rerun_adds_nothing(spark, raw, tmp_path):
    store = str(tmp_path / "store")
    for _ in range(2):
        posts, comments = load_dumps(spark, str(raw), store)
    assert sorted((r["id"], r["selftext"], r["score"]) for r in posts.collect()) == [("a", "", 5), ("b", "x", 7), ("c", "y", 1)]
    assert sorted(r["id"] for r in comments.collect()) == ["c0", "c2", "c3", "c4"]
    out = export_threads(posts, comments, str(tmp_path / "train.parquet"))
    assert {r["id"]: r["text"] for r in out.collect()} == {"a": "T\n\n\nbody 4\n\nbody 3\n\nbody 2", "b": "U\nx\n\n"}


def test_all_comment_levels_and_categories(spark, raw):
    everything = dumps.comments(spark, f"{raw}/{dumps.COMMENT_DUMPS}", top_level_only=False)
    assert everything.count() == 5
    posts = dumps.posts_with_category(spark, f"{raw}/{dumps.POST_DUMPS}")
    assert {r["id"]: (r["category"], r["num_comments"]) for r in posts.collect()} == {"a": ("keto", None), "b": ("vegan", 2), "c": (None, None)}


def test_bad_lines_are_quarantined(spark, raw):
    good, bad = dumps.tolerant(spark, f"{raw}/{dumps.POST_DUMPS}", dumps.RAW_POST)
    assert good.count() == 3
    assert sorted(r["line"] for r in bad.collect()) == ["plain words", "{broken"]


def test_inventory(spark, raw):
    rows = {r["dataset"]: r for r in dumps.dataset_inventory(spark, str(raw)).collect()}
    assert set(rows) == {"keto", "vegan"}
    assert rows["keto"]["has_comments"] and not rows["vegan"]["has_comments"]
    assert rows["vegan"]["dataset_group"] == "plantbaseddiet_combined"


def test_csv_in_both_encodings(spark, tmp_path):
    for name, encoding in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        (tmp_path / name).write_bytes(f'Comment,Sentiment\n"Café, très bon",{len(name)}\nplain,0\n'.encode(encoding))
    paths = [str(tmp_path / n) for n in ("u.csv", "l.csv")]
    rows = tables.read_csv(spark, paths, "Comment string, Sentiment int").collect()
    assert sorted(r["Comment"] for r in rows) == ["Café, très bon", "Café, très bon", "plain", "plain"]
    kinds = {r["path"][-5:]: r["encoding"] for r in tables.file_encodings(spark, paths).collect()}
    assert kinds == {"u.csv": "UTF-8", "l.csv": "ISO-8859-1"}


def test_table_by_extension(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "t.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert tables.load_table(spark, str(tmp_path / "t.parquet")).count() == 3
    assert tables.load_table(spark, str(tmp_path / "t.jsonl"), "id long").count() == 2
    with pytest.raises(ValueError):
        tables.load_table(spark, "t.xml")


def test_unknown_columns_raise(spark):
    with pytest.raises(ValueError, match="expected one of"):
        tables.canonical_columns(spark.range(1))


def test_task_files(spark, tmp_path):
    rows = [{"id": i, "data": {"text": f"t{i}"}, "annotations": []} for i in range(3)]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name, array in (("array.json", True), ("lines.json", False)):
        out = tasks.annotated_tasks(spark, str(tmp_path / name), array)
        assert out.schema.names == [*TASK_SCHEMA.names, "record"] and out.count() == 3
        assert json.loads(out.where("id = 1").first()["record"]) == rows[1]


def test_json_array_is_whole(spark, tmp_path):
    df = spark.createDataFrame([("1", "é", None), ("2", "b", "c")], "id string, text string, diet string")
    sk.write_json_array(df, str(tmp_path / "tasks"))
    content = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "tasks").glob("part-*")))
    assert sorted(json.loads(content), key=lambda r: r["id"]) == [
        {"id": "1", "text": "é", "diet": None}, {"id": "2", "text": "b", "diet": "c"}
    ]
    sk.write_json_array(spark.range(12_000).repartition(7), str(tmp_path / "more"))
    content = "".join(p.read_text() for p in (tmp_path / "more").glob("part-*"))
    assert sorted(r["id"] for r in json.loads(content)) == list(range(12_000))
    sk.write_json_array(df.where("false"), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []


def test_json_arrays_are_bounded_and_whole(spark, tmp_path, monkeypatch):
    def records(name):
        files = [json.loads(p.read_text(encoding="utf-8")) for p in (tmp_path / name).glob("part-*")]
        return max(map(len, files)), sorted(r["id"] for rows in files for r in rows)

    monkeypatch.setattr(sk, "ROWS_PER_ARRAY", 50)
    df = spark.range(1_200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("é\n\"],["), "id").alias("diet"))
    sk.write_json_arrays(df, str(tmp_path / "rows"))
    most, ids = records("rows")
    assert most <= 60 and ids == sorted(map(str, range(1_200)))
    out = tasks.annotated_tasks(spark, str(tmp_path / "rows"), array_file=True)
    assert len(out.inputFiles()) == 24
    assert sorted(json.loads(r.record)["diet"] for r in out.collect()) == sorted(f'é\n"],[{i}' for i in range(1_200))
    monkeypatch.setattr(sk, "CHARS_PER_ARRAY", 400)
    sk.write_json_arrays(df, str(tmp_path / "chars"))
    assert records("chars")[0] <= 25 and records("chars")[1] == ids
    sk.write_json_arrays(df.where("false"), str(tmp_path / "none"))
    assert tasks.annotated_tasks(spark, str(tmp_path / "none"), array_file=True).count() == 0


NASTY = ["}", '{"a": [', "\\", 'é\n"},{"', '\\"}', "", "]}]", '"', "\\u007d {", "\t\\\\\"]"]


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of some thousand bytes."""
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, "2000b")
    yield
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("layout", [{}, {"indent": 4}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 1}])
def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_ranges, layout):
    rnd = random.Random(len(layout))
    rows = [
        {"id": i, "text": "".join(rnd.choices(NASTY, k=rnd.randint(0, 8))), "nested": [{"x": [{}, {"y": NASTY[i % 10]}]}] * rnd.randint(0, 3), NASTY[i % 10]: None}
        for i in range(300)
    ]
    # Records over many ranges, and elements that aren't records.
    rows[7]["text"], rows[200]["nested"] = "long }" * 1700, [{"k": j} for j in range(900)]
    mixed = [*rows[:100], 5, "te}xt{", [1, {"in": "a list"}, [{}] * 900], None, *rows[100:]]
    (tmp_path / "export.json").write_text("\n " + json.dumps(mixed, **layout) + "\n", encoding="utf-8")
    (tmp_path / "other.json").write_text(json.dumps(rows[:5], **layout), encoding="utf-8")
    out = array_records(spark, str(tmp_path / "*.json"))
    assert spark.read.text(str(tmp_path / "export.json"), lineSep="}").rdd.getNumPartitions() > 10
    found = sorted((json.loads(r.record) for r in out.collect()), key=lambda r: (r["id"], str(r)))
    assert found == sorted(rows + rows[:5], key=lambda r: (r["id"], str(r)))


def test_arrays_without_records(spark, tmp_path):
    for name, content in (("a", "[]"), ("b", ""), ("c", " [ 1, \"}\" ] "), ("d", '{"not": "an array"}')):
        (tmp_path / f"{name}.json").write_text(content)
    assert array_records(spark, str(tmp_path)).count() == 0


def test_annotated_query_reads_bounded_arrays(spark, monkeypatch):
    from threadloom.queries import annotation

    monkeypatch.setattr(sk, "ROWS_PER_ARRAY", 10)
    out = annotation.annotated(spark, "/root/testdata/sf0.001", array_file=True)
    assert len(out.inputFiles()) == -(-out.count() // 10) > 1


def test_append_keeps_the_newest_copy(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "id string, v int")
    sk.append_new(df, path, "id", ["v"])
    sk.append_new(df.withColumn("v", F.lit(9)), path, "id", ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 3), ("b", 2)]


def test_rows_without_a_key_are_not_stored(spark, tmp_path):
    path = str(tmp_path / "keys")
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 3), ("b", 2)], "id string, v int")
    for _ in range(3):
        sk.append_new(df, path, "id", ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 3), ("b", 2)]
    assert sk.without_key(df, "id").count() == 2


def test_stream_scores_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    run = lambda: score_new_files(
        spark, str(source), str(target), "text string", str(tmp_path / "state"), lambda df: df.withColumn("n", F.length("text")), 1
    )
    for name in ("a", "b"):
        (source / f"{name}.jsonl").write_text(f'{{"text": "{name}"}}\n{{"text": "{name * 3}"}}\n')
        run()
    run()
    assert sorted(map(tuple, spark.read.parquet(str(target)).collect())) == [("a", 1), ("aaa", 3), ("b", 1), ("bbb", 3)]


def test_balance_job_from_dumps(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    texts = {"good": "great great great", "bad": "awful awful awful", "plain": "a table"}
    for name in ("keto", "vegan", "vegetarian", "lonely"):
        kinds = list(texts) if name != "lonely" else ["good"]
        posts = [
            {"id": f"{name}-{kind}-{i}", "subreddit": name, "title": texts[kind], "score": i, "created_utc": i}
            for kind in kinds for i in range(4)
        ]
        write(raw / f"{name}_submissions", posts, bad=["oops"])
        comments = [
            {"id": f"{p['id']}-{j}", "link_id": f"t3_{p['id']}", "body": texts["good"], "score": str(j), "subreddit": name, "created_utc": j}
            for p in posts for j in range(5)
        ]
        if name != "vegetarian":
            write(raw / f"{name}_comments", comments)
    lexicon = spark.createDataFrame([("great", 3.1), ("awful", -2.0)], "token string, valence double")
    from threadloom.operators.threads import best_first
    from threadloom.plans.balance import balance_dumps

    out = str(tmp_path / "out")
    bad = str(tmp_path / "bad")
    summary = balance_dumps(spark, str(raw), out, lexicon, target=5, comment_order=best_first("id"), quarantine=bad)
    lines = spark.read.json(bad).collect()
    assert [r["line"] for r in lines] == ["oops"] * 4 and len({r["file_path"] for r in lines}) == 4
    written = spark.read.json(out)
    posts = written.where("parent_id is null").groupBy("dataset_group", "sentiment").count().collect()
    sizes = {(r["dataset_group"], r["sentiment"]): r["count"] for r in posts}
    kinds = ("positive", "negative", "neutral")
    assert sizes == {**{("keto", s): 4 for s in kinds}, **{("plantbaseddiet_combined", s): 5 for s in kinds}}
    tops = written.where("parent_id is not null")
    assert {r["score"] for r in tops.collect()} == {4, 3}
    vegan = written.where("parent_id is null and subreddit = 'vegan'").count()
    totals = {r["dataset"]: r["objects"] for r in summary.collect()}
    assert totals["keto"] == 12 * 3 and totals["plantbaseddiet_combined"] == 15 + 2 * vegan
    assert totals["(total)"] == totals["keto"] + totals["plantbaseddiet_combined"] and len(totals) == 3


def test_written_dumps_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    from threadloom.queries import sources

    spark.range(200).selectExpr(
        "id AS o_orderkey", "id % 30 AS o_custkey", "'O' AS o_orderstatus", "id * 10.5D AS o_totalprice", "timestamp'2020-01-01' AS o_orderdate",
        "'1-URGENT' AS o_orderpriority",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(900).selectExpr(
        "id % 200 AS l_orderkey", "cast(id % 7 AS int) AS l_linenumber", "id AS l_partkey", "id % 10 AS l_suppkey", "id * 1.5D AS l_extendedprice",
        "timestamp'2020-01-01' AS l_shipdate",
    ).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(sk, "LINES_PER_FILE", 100)
    raw = sources.write_dumps(spark, str(tmp_path))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(raw)
    lines = spark.read.text(f"{raw}/orders_comments")
    assert files.where("path LIKE '%orders_comments%'").count() >= 9 and lines.count() == 900
    packed = files.where("path LIKE '%orders_comments%'").selectExpr("sum(length)").first()[0]
    assert packed * 3 < lines.selectExpr("sum(octet_length(value) + 1)").first()[0]
    posts, comments = load_dumps(spark, raw, str(tmp_path / "store"))
    assert posts.count() == 200 and comments.count() == sum(i % 7 <= 5 for i in range(900))


def test_a_long_array_is_written_by_many_tasks(spark, tmp_path, small_ranges, monkeypatch):
    df = spark.createDataFrame([(i, NASTY[i % 10] * 20) for i in range(600)], "id long, text string").repartition(7)
    monkeypatch.setattr(sk, "ONE_FILE_BYTES", 5_000)
    sk.write_json_array(df, str(tmp_path / "long"))
    files = sorted((tmp_path / "long").glob("part-*"))
    content = [p.read_text(encoding="utf-8") for p in files]
    assert len(files) > 5 and max(map(len, content)) < sum(map(len, content)) / 4
    expected = sorted((i, NASTY[i % 10] * 20) for i in range(600))
    assert sorted((r["id"], r["text"]) for r in json.loads("".join(content))) == expected
    found = [json.loads(r.record) for r in array_records(spark, str(tmp_path / "long")).collect()]
    assert sorted((r["id"], r["text"]) for r in found) == expected
    # As one array of whole records again, also of one element, and beside arrays that end in their files.
    records = array_records(spark, str(tmp_path / "long"))
    tasks.write_record_array(records, str(tmp_path / "again"))
    assert array_records(spark, [str(tmp_path / "again"), str(tmp_path / "long")]).count() == 1200
    monkeypatch.setattr(sk, "ONE_FILE_BYTES", 10)
    sk.write_json_array(df.where("id = 3"), str(tmp_path / "one"))
    assert len(json.loads("".join(p.read_text() for p in sorted((tmp_path / "one").glob("part-*"))))) == 1
    assert array_records(spark, str(tmp_path / "one")).count() == 1
