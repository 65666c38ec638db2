"""Score JSON lines in bounded batches, each input file exactly once.

The batch jobs read a folder whole. For a folder that keeps growing, the same
row-wise scoring runs as a stream over the files: a trigger takes at most
``files_per_batch`` of them and the checkpoint remembers what was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T


def score_new_files(
    spark: SparkSession, source: str, target: str, schema: T.StructType | str, checkpoint: str,
    score: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000,
) -> None:
    """Read the files not seen before, apply ``score``, append Parquet, stop."""
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = (
        score(lines)
        .writeStream.format("parquet")
        .option("path", target)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
