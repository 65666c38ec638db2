"""Post and comment dumps: newline-delimited JSON, plain or compressed.

A compressed dump (.zst, .gz) is read by one task per file, so load it once
into Parquet (``sinks.tables``) and work on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from threadloom.functions import text as tx
from threadloom.functions.labels import category_of
from threadloom.session import spread

# Epochs and scores come as text or number, so they are read as text.
RAW_POST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("num_comments", T.StringType()),
    T.StructField("created_utc", T.StringType()),
])
RAW_COMMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("link_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("created_utc", T.StringType()),
])
# A dump is a file, or a folder of files, with one of these endings.
POST_DUMPS = "*_submissions*"
COMMENT_DUMPS = "*_comments*"
_DUMP = r"([^/=]+)_(submissions|comments)(\.[^/]*)?(/[^/]*)?$"
CORRUPT = "_corrupt_record"

# Data sets with one of these words in their name belong together.
PLANT_BASED_NAMES = ("plantbaseddiet", "vegan", "vegetarian")
PLANT_BASED_GROUP = "plantbaseddiet_combined"


def raw_records(
    spark: SparkSession, path: str | list[str], schema: T.StructType, partitions: int | None = None
) -> DataFrame:
    """All records below ``path``, with the path of the file they came from.

    Lines that are no JSON objects stay as rows with ``_corrupt_record`` set. A
    compressed dump is one task's to read; ``partitions`` deals its lines out.
    """
    source = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    lines = spread(source, partitions).where(F.length("value") > 0)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    record = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(record.alias("_record"), "file_path").select("_record.*", "file_path")


def tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the quarantined lines with their file paths."""
    raw = raw_records(spark, path, schema)
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.where(F.col(CORRUPT).isNotNull()).select("file_path", F.col(CORRUPT).alias("line"))
    return good, bad


def whole_number(col: Column) -> Column:
    """A score given as number or text; text that is no number gives null."""
    return F.coalesce(col.try_cast("bigint"), col.try_cast("double").try_cast("bigint"))


def posts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Canonical posts; null texts become empty."""
    raw, _ = tolerant(spark, path, RAW_POST)
    return raw.select(
        "id",
        "subreddit",
        tx.null_text(F.col("title")).alias("title"),
        tx.null_text(F.col("selftext")).alias("selftext"),
        whole_number(F.col("score")).alias("score"),
        tx.epoch_to_timestamp(F.col("created_utc")).alias("created_ts"),
    )


def posts_with_category(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Posts with escapes cleaned, comment count and category; texts may be null."""
    raw, _ = tolerant(spark, path, RAW_POST)
    return raw.select(
        "id",
        "subreddit",
        "title",
        tx.clean_escapes(F.col("selftext")).alias("selftext"),
        tx.epoch_to_timestamp(F.col("created_utc")).alias("created_ts"),
        whole_number(F.col("score")).try_cast("int").alias("score"),
        whole_number(F.col("num_comments")).try_cast("int").alias("num_comments"),
        category_of(F.col("subreddit")).alias("category"),
    )


def is_top_level(parent_id: Column) -> Column:
    """Parent ids like ``t3_...``; the underscore matches any character."""
    return parent_id.like("t3_%")


def comments(
    spark: SparkSession, path: str | list[str], top_level_only: bool = True
) -> DataFrame:
    raw, _ = tolerant(spark, path, RAW_COMMENT)
    if top_level_only:
        raw = raw.where(is_top_level(F.col("parent_id")))
    return raw.select(
        "id",
        tx.drop_prefix3(F.col("link_id")).alias("post_id"),
        "author",
        tx.null_text(F.col("body")).alias("body"),
        whole_number(F.col("score")).alias("score"),
        tx.epoch_to_timestamp(F.col("created_utc")).alias("created_ts"),
    )


def dataset_name(file_path: Column) -> Column:
    """Name before ``_submissions`` or ``_comments``; empty for other files."""
    return F.regexp_extract(file_path, _DUMP, 1)


def dump_kind(file_path: Column) -> Column:
    """``submissions`` or ``comments``; empty for other files."""
    return F.regexp_extract(file_path, _DUMP, 2)


def dataset_group(dataset: Column) -> Column:
    """Plant-based data sets share one group; every other is its own."""
    plant = None
    for word in PLANT_BASED_NAMES:
        hit = F.contains(F.lower(dataset), F.lit(word))
        plant = hit if plant is None else plant | hit
    return F.when(plant, PLANT_BASED_GROUP).otherwise(dataset)


def dataset_inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Data sets with posts: their group, number of files, and whether comments exist.

    Only the file listing is read. Files that are no dumps, such as a README,
    are left out; posts and comments pair up by data set name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    dumps = files.select(dataset_name(F.col("path")).alias("dataset"), dump_kind(F.col("path")).alias("kind"))
    counts = dumps.where(F.col("dataset") != "").groupBy("dataset").agg(
        F.count(F.when(F.col("kind") == "submissions", 1)).alias("n_post_files"),
        F.count(F.when(F.col("kind") == "comments", 1)).alias("n_comment_files"),
    )
    return counts.where(F.col("n_post_files") > 0).select(
        "dataset", dataset_group(F.col("dataset")).alias("dataset_group"), "n_post_files",
        (F.col("n_comment_files") > 0).alias("has_comments"),
    )
