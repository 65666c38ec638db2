"""Annotation files, read and written as whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.functions.annotations import TASK_SCHEMA
from threadloom.sinks.tables import write_array_file
from threadloom.sources.arrays import array_records


def annotated_tasks(spark: SparkSession, path: str | list[str], array_file: bool = False) -> DataFrame:
    """Annotated tasks, one per line, or one JSON array per file.

    ``record`` has the whole task as text, with every key it came with; ``id``,
    ``data`` and ``annotations`` are what the label functions need of it. An
    array file is read by as many tasks as its size asks for.
    """
    if array_file:
        records = array_records(spark, path)
    else:
        records = spark.read.text(path).withColumnRenamed("value", "record").where(F.trim("record") != "")
    return records.withColumn("_task", F.from_json("record", TASK_SCHEMA)).select("_task.*", "record")


def write_records(tasks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Whole records again, one per line."""
    tasks.select("record").write.mode(mode).text(path)


def write_record_array(tasks: DataFrame, path: str) -> None:
    """Whole records again, as one array in one file, which labelling tools take."""
    write_array_file(tasks.select(F.col("record").alias("value")), path)
