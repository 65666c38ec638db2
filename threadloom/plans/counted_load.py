"""A load whose counts travel with the write: good, bad and stored rows per data set from one action.

The dump's lines are parsed once. Good records and quarantined lines go to one
table with a folder for each, and observed metrics count them as they pass into
it, so no table is read again to be counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from threadloom.sources import dumps

LOG = "dataset string, good long, bad long, read long"
GOOD, BAD = "good", "bad"


def load_counted(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, store: str) -> DataFrame:
    """Stores the records of dumps below ``store`` and returns the load log, a line for each data set and a total.

    ``good(store)`` and ``quarantined(store)`` read what was stored. The metrics
    are taken in the tasks that write, each counted once however often it was
    tried. There are two for each data set, whose names come from the listing.
    """
    raw = dumps.raw_records(spark, path, schema)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    # One row for a data set; the files themselves are not opened.
    names = sorted(r[0] for r in listed.select(dumps.dataset_name(F.col("path"))).distinct().collect())
    bad = F.col(dumps.CORRUPT).isNotNull()
    dataset = dumps.dataset_name(F.col("file_path"))
    metrics = [
        F.count(F.when((dataset == name) & (bad if side == BAD else ~bad), 1)).alias(f"{side}_{i}")
        for i, name in enumerate(names) for side in (GOOD, BAD)
    ]
    seen = Observation()
    rows = raw.withColumn("kind", F.when(bad, BAD).otherwise(GOOD))
    if metrics:
        rows = rows.observe(seen, *metrics)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(store)
    counts = seen.get if metrics else {}
    log = [(name, counts[f"{GOOD}_{i}"], counts[f"{BAD}_{i}"]) for i, name in enumerate(names)]
    log.append(("(total)", sum(n for _, n, _ in log), sum(n for _, _, n in log)))
    return spark.createDataFrame([(name, n, m, n + m) for name, n, m in log], LOG)


def good(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The stored records with the path of their file."""
    return _stored(spark, store, schema, GOOD).drop(dumps.CORRUPT)


def quarantined(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The lines that are no records, with the path of their file."""
    return _stored(spark, store, schema, BAD).select("file_path", F.col(dumps.CORRUPT).alias("line"))


def _stored(spark: SparkSession, store: str, schema: T.StructType, kind: str) -> DataFrame:
    own = [*schema.fields, T.StructField(dumps.CORRUPT, T.StringType()), T.StructField("file_path", T.StringType())]
    return spark.read.schema(T.StructType([*own, T.StructField("kind", T.StringType())])).parquet(store).where(F.col("kind") == kind).drop("kind")
