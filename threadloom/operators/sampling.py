"""Reproducible samples, splits and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.functions.hashing import SEED, order_key
from threadloom.functions.labels import SENTIMENTS
from threadloom.operators.ranking import integral, segment_by_rank, share_down, share_up


# Rows that one task may gather as the head of an order.
PAGE = 10_000


def random_rows(df: DataFrame, n: int, ids: Sequence[str], seed: int = SEED, page: int = PAGE) -> DataFrame:
    """``n`` rows chosen at random, the same ones every time.

    A page of rows is gathered by one task. For more the border of the order is
    found by counts, and every task keeps its rows on this side of it.
    """
    key = order_key(*ids, seed=seed)
    if n <= page:
        return df.orderBy(key).limit(n)
    marked = segment_by_rank(df, key, [("in", lambda total: F.least(total, F.lit(n).cast("bigint")))], out="_pick")
    return marked.where(F.col("_pick") == "in").drop("_pick")


def shuffled(df: DataFrame, ids: Sequence[str], seed: int = SEED, limit: int | None = None, page: int = PAGE) -> DataFrame:
    """All rows in random order; with ``limit`` the first rows of that order."""
    key = order_key(*ids, seed=seed)
    if limit is None:
        return df.orderBy(key)
    return random_rows(df, limit, ids, seed, page).orderBy(key)


def balanced(
    df: DataFrame,
    label: str,
    ids: Sequence[str],
    target: int | None = 1000,
    classes: Sequence[str] | None = SENTIMENTS,
    by: Sequence[str] = (),
    seed: int = SEED,
) -> DataFrame:
    """Equally many rows of each class: ``target``, or the smallest class.

    With ``classes`` given, rows of other classes are left out, and a group of
    ``by`` that lacks one of the classes gives no rows at all. ``target=None``
    takes as many as the smallest class has.
    """
    if classes is not None:
        df = df.where(F.col(label).isin(*classes))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))

    def size(total: Column) -> Column:
        smallest = F.min(total).over(group)
        wanted = smallest if target is None else F.least(smallest, F.lit(target).cast("bigint"))
        if classes is None:
            return wanted
        complete = F.size(F.collect_set(label).over(group)) == len(classes)
        return F.when(complete, wanted).otherwise(F.lit(0).cast("bigint"))

    marked = segment_by_rank(df, order_key(*ids, seed=seed), [("in", size)], strata=[*by, label], out="_pick")
    return marked.where(F.col("_pick") == "in").drop("_pick")


def capped(
    df: DataFrame,
    label: str,
    caps: Mapping[str, int],
    uncapped: Sequence[str],
    order: Sequence[Column],
) -> DataFrame:
    """The first rows of each capped class and all rows of the uncapped ones."""
    most = max(caps.values())
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    # The literal bound lets Spark drop the surplus of a class before the shuffle.
    first = df.where(F.col(label).isin(*caps)).withColumn("_rank", rank).where(F.col("_rank") <= most)
    within = None
    for name, cap in caps.items():
        fits = (F.col(label) == name) & (F.col("_rank") <= cap)
        within = fits if within is None else within | fits
    return first.where(within).drop("_rank").unionByName(df.where(F.col(label).isin(*uncapped)))


def split_two(
    df: DataFrame, ids: Sequence[str], held_out: str | float = "0.2", strata: Sequence[str] = (),
    names: tuple[str, str] = ("train", "test"), seed: int = SEED,
) -> DataFrame:
    """Random split with exactly ceil(held_out * n) rows held out per stratum."""
    borders = [(names[1], share_up(held_out))]
    return segment_by_rank(df, order_key(*ids, seed=seed), borders, rest=names[0], strata=strata, out="split")


def split_three(
    df: DataFrame, ids: Sequence[str], strata: Sequence[str] = (), test: str | float = "0.2",
    val_of_rest: str | float = "0.25", seed: int = SEED,
) -> DataFrame:
    """Two-stage split: test first, then validation out of what is left."""
    first, second = share_up(test), share_up(val_of_rest)
    borders = [("test", first), ("val", lambda n: first(n) + second(n - first(n)))]
    return segment_by_rank(df, order_key(*ids, seed=seed), borders, rest="train", strata=strata, out="split")


def folds(df: DataFrame, ids: Sequence[str], k: int, strata: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """Fold numbers 0 .. k-1; fold sizes differ by at most one per stratum."""
    borders = [(str(i), lambda n, i=i: integral(n * (i + 1), k)) for i in range(k)]
    out = segment_by_rank(df, order_key(*ids, seed=seed), borders, strata=strata, out="fold")
    return out.withColumn("fold", F.col("fold").cast("int"))


def nested_fractions(
    df: DataFrame, ids: Sequence[str], fractions: Sequence[str], strata: Sequence[str] = (), seed: int = SEED
) -> DataFrame:
    """One copy of a row for every fraction whose subset holds it.

    Subsets are nested: the first floor(f * n) rows of one random order, or of
    each stratum's order.
    """
    marked = first_fraction(df, ids, fractions, strata, seed, "_from")
    steps = F.array(*[F.lit(float(Fraction(f))) for f in fractions])
    start = F.col("_from") + 1
    return (
        marked.where(F.col("_from").isNotNull())
        .withColumn("fraction", F.explode(F.slice(steps, start, F.lit(len(fractions)))))
        .drop("_from")
    )


def first_fraction(
    df: DataFrame, ids: Sequence[str], fractions: Sequence[str], strata: Sequence[str] = (), seed: int = SEED,
    out: str = "first_step",
) -> DataFrame:
    """The number of the first of the rising ``fractions`` whose subset holds the row; null if none does."""
    borders = [(str(i), share_down(f)) for i, f in enumerate(fractions)]
    marked = segment_by_rank(df, order_key(*ids, seed=seed), borders, strata=strata, out=out)
    return marked.withColumn(out, F.col(out).cast("int"))


def fraction_steps(first: str, last: str, count: int) -> list[str]:
    """``count`` evenly spaced fractions as exact decimal-free text."""
    lo, hi = Fraction(first), Fraction(last)
    return [str(lo + (hi - lo) * i / (count - 1)) for i in range(count)]
