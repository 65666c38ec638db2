"""Cut a data set at exact ranks without sorting it.

A rank within a class would put the whole class into one task. Here every row
carries a key that starts with hash digits, so the rows fall evenly into
buckets by key prefix. Bucket counts locate the bucket that holds each border;
only the rows of those buckets are ranked, and only to read off the border's
key. The final pass compares every row with at most a handful of border keys:
a narrow scan, no shuffle of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.session import pinned, small_side

# 16 ** 3 buckets per stratum: a border bucket holds 1/4096 of its stratum.
PREFIX_DIGITS = 3
# Rows of one bucket that one task may sort.
BUCKET_ROWS = 1_000_000


def integral(part: Column, whole: Column | int) -> Column:
    whole = F.lit(whole).cast("bigint") if isinstance(whole, int) else whole
    return F.call_function("div", part, whole)


def share_up(share: str | float) -> Callable[[Column], Column]:
    """ceil(share * n) in whole numbers."""
    f = Fraction(str(share))
    return lambda n: integral(n * f.numerator + (f.denominator - 1), f.denominator)


def share_down(share: str | float) -> Callable[[Column], Column]:
    """floor(share * n) in whole numbers."""
    f = Fraction(str(share))
    return lambda n: integral(n * f.numerator, f.denominator)


def segment_by_rank(
    df: DataFrame,
    key: Column,
    borders: Sequence[tuple[str, Callable[[Column], Column]]],
    rest: str | None = None,
    strata: Sequence[str] = (),
    out: str = "segment",
    prefix_digits: int = PREFIX_DIGITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Label each row by the segment its rank within ``strata`` falls into.

    ``key`` is a unique text key from ``hashing.order_key``. ``borders`` lists
    (segment, upper rank) in ascending order; an upper rank is an expression of
    the stratum size and may use windows over the strata columns. Rows past the
    last border get ``rest``. Border keys are computed at call time.
    """
    strata = list(strata)
    groups = strata or ["_all"]
    narrow = df if strata else df.withColumn("_all", F.lit(1))
    narrow = narrow.select(*groups, key.alias("_key")).withColumn("_prefix", F.left("_key", F.lit(prefix_digits)))

    # At most 16 ** prefix_digits rows per stratum from here on.
    histogram = narrow.groupBy(*groups, "_prefix").agg(F.count("*").alias("_n"))
    cumulative = _cumulative(histogram, groups).withColumn("total", F.sum("_n").over(Window.partitionBy(*groups)))
    total = F.col("total")
    for i, (_, upper) in enumerate(borders):
        cumulative = cumulative.withColumn(f"_rank{i}", F.least(upper(total).cast("bigint"), total))
    numbered = F.array(*[F.struct(F.lit(i).alias("_no"), F.col(f"_rank{i}").alias("_rank")) for i in range(len(borders))])
    places = cumulative.select(*groups, "_prefix", "_upto", "_n", F.inline(numbered)).where(_holds_rank())
    places, small = pinned(places.select(*groups, "_prefix", "_no", "_n", _rank_inside().alias("_rank")))

    # A bucket that is still too big for one task is divided by more digits.
    digits = prefix_digits
    while digits < 32 and (places.agg(F.max("_n")).first()[0] or 0) > bucket_rows:
        digits += prefix_digits
        buckets = places.select(*groups, F.col("_prefix").alias("_outer")).distinct()
        inner = narrow.withColumn("_outer", F.left("_key", F.lit(digits - prefix_digits)))
        inner = _match(inner, _hinted(buckets, small), [*groups, "_outer"])
        parts = inner.groupBy(*groups, "_outer", F.left("_key", F.lit(digits)).alias("_prefix")).agg(F.count("*").alias("_n"))
        parts = _cumulative(parts, [*groups, "_outer"])
        outer = places.select(*groups, F.col("_prefix").alias("_outer"), "_no", "_rank")
        places = _match(parts, _hinted(outer, small), [*groups, "_outer"]).where(_holds_rank())
        places, small = pinned(places.select(*groups, "_prefix", "_no", "_n", _rank_inside().alias("_rank")))

    wanted = places.groupBy(*groups, "_prefix").agg(F.collect_list(F.struct("_rank", "_no")).alias("_wanted"))
    within = Window.partitionBy(*groups, "_prefix").orderBy("_key")
    candidates = narrow.withColumn("_prefix", F.left("_key", F.lit(digits)))
    hits = (
        _match(candidates, _hinted(wanted, small), [*groups, "_prefix"])
        .withColumn("_at", F.row_number().over(within).cast("bigint"))
        .withColumn("_hit", F.filter("_wanted", lambda w: w["_rank"] == F.col("_at")))
        .select(*groups, "_key", F.explode("_hit._no").alias("_no"))
    )
    cuts = hits.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_no") == i, F.col("_key"))).alias(f"_cut{i}") for i in range(len(borders))]
    )

    keyed = df.withColumn("_key", key)
    if strata:
        marked = _match(keyed, small_side(cuts), groups, how="left")
        keys = [F.col(f"_cut{i}") for i in range(len(borders))]
    else:
        only = cuts.first()
        marked = keyed
        keys = [F.lit(only[f"_cut{i}"] if only else None).cast("string") for i in range(len(borders))]
    label = None
    for (name, _), cut in zip(borders, keys):
        inside = F.col("_key") <= cut
        label = F.when(inside, F.lit(name)) if label is None else label.when(inside, F.lit(name))
    label = label.otherwise(F.lit(rest)) if rest is not None else label
    return marked.select(*df.columns, label.alias(out))


def _cumulative(histogram: DataFrame, groups: Sequence[str]) -> DataFrame:
    running = Window.partitionBy(*groups).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("_upto", F.sum("_n").over(running))


def _holds_rank() -> Column:
    return (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))


def _rank_inside() -> Column:
    return F.col("_rank") - (F.col("_upto") - F.col("_n"))


def _hinted(lookup: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(lookup) if small else lookup


def _match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match each other."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
