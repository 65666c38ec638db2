"""Counts, distributions, cross-tabulations and numeric summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from threadloom.functions.labels import percent


def smallest_class(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Class count and the smallest count; a class without rows counts 0."""
    counts = df.agg(*[F.count(F.when(F.col(label) == c, 1)).alias(f"n_{c}") for c in classes])
    return counts.withColumn("min_n", F.least(*[f"n_{c}" for c in classes]))


def distribution(df: DataFrame, *cols: str) -> DataFrame:
    """Count and share in percent of each value."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", percent(F.col("n"), total))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``col`` values as columns, one row per ``row`` value."""
    return df.groupBy(row).agg(*[F.count(F.when(F.col(col) == v, 1)).alias(str(v)) for v in values])


def crosstab_percent(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    counts = crosstab(df, row, col, values)
    total = sum((F.col(str(v)) for v in values[1:]), F.col(str(values[0])))
    return counts.select(row, *[percent(F.col(str(v)), total).alias(str(v)) for v in values])


def label_report(df: DataFrame, label: str, topic: str) -> DataFrame:
    """(level, topic, label, n, pct) from one scan: all rows, rows by label, by topic, and by label within a topic.

    Grouping sets count every level in the pass that reads the rows. A percentage
    is that of all rows, within a topic that of the topic's.
    """
    counts = df.groupingSets([[], [F.col(label)], [F.col(topic)], [F.col(topic), F.col(label)]], F.col(topic), F.col(label)).agg(
        F.grouping_id().alias("_gone"), F.count("*").alias("n")
    )
    # One row per topic and label is left.
    every = F.max(F.when(F.col("_gone") == 3, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    of_topic = F.max(F.when(F.col("_gone") == 1, F.col("n"))).over(Window.partitionBy(topic))
    whole = F.when(F.col("_gone") == 0, of_topic).otherwise(every)
    level = F.element_at(F.array(*[F.lit(x) for x in ("topic and label", "topic", "label", "all")]), F.col("_gone").cast("int") + 1)
    return counts.select(level.alias("level"), F.col(topic).alias("topic"), F.col(label).alias("label"), "n", percent(F.col("n"), whole).alias("pct"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns and nulls per column, in one pass: a row per column."""
    nulls = df.agg(F.count("*").alias("_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    per_column = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in df.columns])
    return nulls.select("_rows", F.inline(per_column)).select(
        "column_name", "nulls", F.col("_rows").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")
    )


# Values that may be ranked in one task at the end of a selection.
SELECTION_ROWS = 100_000


def values_at_ranks(
    values: DataFrame, ranks: Sequence[int], size: int, low: float, high: float,
    max_rows: int = SELECTION_ROWS, accuracy: int = 10_000,
) -> dict[int, float]:
    """The values at the given 1-based ranks of column ``v``, without a sort.

    Each rank starts with the bracket [low, high]. A sketch of bounded size
    narrows every bracket that still holds more than ``max_rows`` rows; counts
    check that the rank stayed inside. What is left is ranked exactly.
    """
    v = F.col("v")
    brackets = {r: (low, high) for r in ranks}
    placed = {r: (0, size) for r in ranks}
    slack = 2.0 / accuracy

    def inside(r: int):
        return v.between(*brackets[r])

    def open_ranks() -> list[int]:
        return [r for r in ranks if placed[r][1] > max_rows and brackets[r][0] < brackets[r][1]]

    while open_ranks():
        todo = open_ranks()
        edges = {}
        for r in todo:
            below, within = placed[r]
            share = (r - below) / within
            edges[r] = [max(share - slack, 0.0), min(share + slack, 1.0)]
        marks = values.agg(
            *[F.percentile_approx(F.when(inside(r), v), edges[r], accuracy).alias(f"m{r}") for r in todo]
        ).first()
        tried = dict(brackets)
        for r in todo:
            lo, hi = marks[f"m{r}"]
            tried[r] = (tried[r][0] if edges[r][0] == 0.0 else lo, tried[r][1] if edges[r][1] == 1.0 else hi)
        counts = values.agg(
            *[F.count(F.when(v < tried[r][0], 1)).alias(f"b{r}") for r in todo],
            *[F.count(F.when(v.between(*tried[r]), 1)).alias(f"i{r}") for r in todo],
        ).first()
        missed = False
        for r in todo:
            below, within = counts[f"b{r}"], counts[f"i{r}"]
            if below < r <= below + within and within < placed[r][1]:
                brackets[r], placed[r] = tried[r], (below, within)
            else:
                missed = True
        if missed:
            slack *= 4
        if slack > 1:
            break

    found = {r: brackets[r][0] for r in ranks if brackets[r][0] == brackets[r][1]}
    rest = [r for r in ranks if r not in found]
    if rest:
        tags = F.array_compact(F.array(*[F.when(inside(r), F.lit(r)) for r in rest]))
        merged = values.select(F.explode(tags).alias("r"), "v").groupBy("r", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        offset = F.lit(0).cast("bigint")
        for r in rest:
            offset = F.when(F.col("r") == r, F.lit(r - placed[r][0]).cast("bigint")).otherwise(offset)
        hit = (F.col("upto") >= offset) & (F.col("upto") - F.col("c") < offset)
        for row in merged.withColumn("upto", upto).where(hit).select("r", "v").collect():
            found[row["r"]] = row["v"]
    return found


def exact_quantiles(
    df: DataFrame, col: str, probabilities: Sequence[float], max_rows: int = SELECTION_ROWS
) -> list[float | None]:
    """Linear-interpolated quantiles of a column, exact; nulls are ignored."""
    values = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    head = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = head["n"]
    if n == 0:
        return [None] * len(probabilities)
    positions = [p * (n - 1) for p in probabilities]
    ranks = sorted({r for x in positions for r in (int(x) + 1, min(int(x) + 2, n))})
    at = values_at_ranks(values, ranks, n, head["lo"], head["hi"], max_rows)
    out = []
    for x in positions:
        low, high = at[int(x) + 1], at[min(int(x) + 2, n)]
        out.append(low + (high - low) * (x - int(x)))
    return out


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum."""
    p25, p50, p75 = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"),
        F.lit(p25).cast("double").alias("p25"), F.lit(p50).cast("double").alias("p50"),
        F.lit(p75).cast("double").alias("p75"), F.max(col).alias("max"),
    )
