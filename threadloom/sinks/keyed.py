"""Tables stored by a key: rows in buckets by hash of the key, so that appends, ranks and joins on it need no shuffle.

A keyed table is a Parquet folder whose files are buckets; its layout (columns,
key, buckets) lies beside it in one row. Readers of the folder that don't know
the layout see plain Parquet. ``keyed_table`` registers it with its layout in the
session, and Spark then plans joins, windows and groups on the key over the
buckets as they lie. One bucket is one task's to read: where a key holds a big
share of the rows (``bucket_shares``), read the folder as plain Parquet, which
gives the same rows over as many tasks as the files have splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from threadloom.operators.threads import latest_per_key
from threadloom.session import setting

LAYOUT = "columns string, key string, buckets int"


def _layout_path(path: str) -> str:
    return f"{path.rstrip('/')}.layout"


def _name(path: str) -> str:
    return f"keyed_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def create_keyed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int | None = None) -> DataFrame:
    """An empty keyed table, unless there is one already.

    It needs at least as many buckets as shuffles have partitions, or Spark
    deals its rows out again.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.createDataFrame([(columns, key, buckets)], LAYOUT).write.mode("ignore").parquet(_layout_path(path))
    return keyed_table(spark, path)


def keyed_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, with the layout known to Spark."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema(LAYOUT).parquet(_layout_path(path)).first()
        spark.sql(
            f"CREATE TABLE {name} ({layout['columns']}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (`{layout['key']}`)"
            f" SORTED BY (`{layout['key']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
        )
    # Files may have come since the last look.
    spark.catalog.refreshTable(name)
    return spark.table(name)


def unseen(df: DataFrame, stored: DataFrame, key: str, newest_first: Sequence[str], within: str | None = None) -> DataFrame:
    """The rows of ``df`` whose key isn't stored, of several with one key the newest."""
    keys = [within, key] if within else [key]
    named = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return latest_per_key(named.join(stored.select(*keys), keys, "left_anti").select(*df.columns), key, *newest_first)


def append_keyed(df: DataFrame, path: str, key: str, newest_first: Sequence[str], within: str | None = None, buckets: int | None = None) -> DataFrame:
    """Stores the rows whose ``key`` isn't stored yet, of several the newest, and returns the table.

    The table is laid out by ``key``, or by ``within``, a column that a key has
    only one value of (a comment's post). Stored rows are not shuffled, only the
    new ones travel to the buckets. Rows without a key aren't stored.
    """
    spark = df.sparkSession
    stored = create_keyed(spark, path, df.schema, within or key, buckets)
    # The buckets of ``within`` serve a join on both columns as they lie.
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        unseen(df, stored, key, newest_first, within).write.insertInto(_name(path))
    return keyed_table(spark, path)


def bucket_shares(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, bytes, share): how the stored bytes lie in the buckets; only the files' footers are read."""
    files = spark.read.parquet(path).select("_metadata.file_name", "_metadata.file_size").distinct()
    bucket = F.regexp_extract("file_name", r"_(\d+)(\.c\d+)?\.", 1)
    sizes = files.where(bucket != "").groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("file_size").alias("bytes"))
    return sizes.withColumn("share", F.col("bytes") / sizes.agg(F.sum("bytes")).scalar())
