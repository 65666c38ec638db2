"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spaces, tabs and line ends; every other character belongs to a word.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from; a row without an id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``doc``, so that extra columns can't clash with working ones."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``doc`` again, some of them replaced."""
    return df.select(*[(changed[c] if c in changed else F.col(f"doc.`{c}`")).alias(c) for c in columns])
