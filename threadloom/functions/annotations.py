"""Labels inside nested annotation records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadloom.functions.labels import LABELS_THREE_WAY, OFFTOPIC_SPELLINGS, encode

_RESULT = T.StructType([
    T.StructField("from_name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StructType([T.StructField("choices", T.ArrayType(T.StringType()))])),
])
TASK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("data", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("result", T.ArrayType(_RESULT))]))),
])

# Labels that make a task count as labelled.
VALID_LABELS = ("positive", "negative", "neutral", *OFFTOPIC_SPELLINGS)


def _first_choice(result: Column) -> Column:
    return F.get(result["value"]["choices"], F.lit(0))


def _all_results(annotations: Column) -> Column:
    empty = F.array().cast(T.ArrayType(_RESULT))
    return F.flatten(F.transform(annotations, lambda a: F.coalesce(a["result"], empty)))


def strict_label(annotations: Column, name: str = "sentiment") -> Column:
    """First choice of the first matching result of the first annotation."""
    first = F.get(annotations, F.lit(0))["result"]
    match = F.filter(first, lambda r: (r["from_name"] == name) & (r["type"] == "choices"))
    return _first_choice(F.get(match, F.lit(0)))


def first_label(annotations: Column, name: str = "sentiment") -> Column:
    """First choice of the first result with choices, over all annotations."""
    match = F.filter(
        _all_results(annotations),
        lambda r: (r["from_name"] == name) & (F.coalesce(F.size(r["value"]["choices"]), F.lit(0)) > 0),
    )
    return _first_choice(F.get(match, F.lit(0)))


def has_valid_label(annotations: Column, valid: Sequence[str] = VALID_LABELS, name: str = "sentiment") -> Column:
    """True if any annotation holds a valid first choice."""
    found = F.exists(
        _all_results(annotations),
        lambda r: F.coalesce((r["from_name"] == name) & _first_choice(r).isin(*valid), F.lit(False)),
    )
    return F.coalesce(found, F.lit(False))


def invalid_labels(df: DataFrame, label: str, mapping: Mapping[str, int] = LABELS_THREE_WAY) -> DataFrame:
    """Labels the encoding does not know, with how often they occur."""
    return df.where(encode(F.col(label), mapping).isNull()).groupBy(label).agg(F.count("*").alias("n"))
