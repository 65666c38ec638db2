"""Tables by path: Parquet, NDJSON and CSV, and their column conventions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from threadloom.session import spread


def load_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None
) -> DataFrame:
    """Read by extension: ``.parquet``, or ``.jsonl`` / ``.ndjson`` with a schema.

    ``partitions`` deals the rows of a few big files out, for heavy work on texts.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spread(spark.read.parquet(path), partitions)
    if path.endswith((".jsonl", ".ndjson")):
        if schema is None:
            raise ValueError("JSON lines need a schema")
        return spread(spark.read.schema(schema).json(path), partitions)
    raise ValueError("input must be .parquet or .jsonl")


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# The column names in use, newest first.
TEXT_AND_LABEL = (("text_content", "sentiment"), ("Comment", "Sentiment"))


def canonical_columns(
    df: DataFrame, known: Sequence[tuple[str, str]] = TEXT_AND_LABEL, names: tuple[str, str] = ("text", "label")
) -> DataFrame:
    """Rename the first known pair of columns to ``names``, keep the rest."""
    for text, label in known:
        if text in df.columns and label in df.columns:
            rest = [c for c in df.columns if c not in (text, label)]
            return df.select(F.col(text).alias(names[0]), F.col(label).alias(names[1]), *rest)
    raise ValueError(f"expected one of the column pairs {list(known)}, found {df.columns}")


def file_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, encoding) per file: UTF-8 if every line is valid, else ISO-8859-1."""
    lines = spark.read.text(path)
    valid = F.is_valid_utf8("value")
    return lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.when(F.min(F.coalesce(valid, F.lit(True))), "UTF-8").otherwise("ISO-8859-1").alias("encoding")
    )


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV with a header; each file is read in the encoding its bytes allow.

    The driver gets the paths of the files, as it does to list them.
    """
    files = file_encodings(spark, path).collect()
    reader = spark.read.schema(schema).option("header", "true").options(**dict(options or {}))
    parts = []
    for encoding in ("UTF-8", "ISO-8859-1"):
        paths = [r["path"] for r in files if r["encoding"] == encoding]
        if paths:
            parts.append(reader.option("encoding", encoding).csv(paths))
    return union_by_name(parts) if parts else spark.createDataFrame([], schema)
