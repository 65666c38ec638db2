"""Evaluation of predictions; every report is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 for an empty whole."""
    return F.coalesce(part / F.nullif(whole, F.lit(0.0)), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """Count of every (label, prediction) pair of ``classes``, zeros kept."""
    kind = df.schema[label].dataType
    row = df.sparkSession.createDataFrame([(c,) for c in classes], ["label"]).withColumn("label", F.col("label").cast(kind))
    grid = row.withColumn("prediction", F.explode(F.array(*[F.lit(c).cast(kind) for c in classes])))
    counts = confusion_counts(df, label, prediction)
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def accuracy(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    right = F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("support"), right.alias("accuracy"))


def _per_class(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Hits, predictions and labels per class; reads the rows once."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("class"), hit.alias("hit"), F.col("n").alias("true"), zero.alias("said")),
        F.struct(F.col("prediction").cast("string").alias("class"), zero.alias("hit"), zero.alias("true"), F.col("n").alias("said")),
    )
    sums = (
        confusion_counts(df, label, prediction, by).select(*by, F.inline(sides)).groupBy(*by, "class")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("hit", "true", "said")])
    )
    scored = sums.withColumn("precision", _ratio(F.col("hit"), F.col("said"))).withColumn(
        "recall", _ratio(F.col("hit"), F.col("true"))
    )
    return scored.withColumn(
        "f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    values = [F.col(c).alias(c) for c in ("precision", "recall", "f1", "true")]
    rows = F.array(
        F.struct(F.col("class").alias("label"), F.lit(1.0).alias("w"), *values),
        F.struct(F.lit("macro avg").alias("label"), F.lit(1.0).alias("w"), *values),
        F.struct(F.lit("weighted avg").alias("label"), F.col("true").alias("w"), *values),
    )
    expanded = _per_class(df, label, prediction, by).select(*by, F.inline(rows))
    return expanded.groupBy(*by, "label").agg(
        *[_ratio(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("true").cast("bigint").alias("support"),
    )


def macro_f1(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-class F1 values, each class counting the same."""
    return _per_class(df, label, prediction, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def split_scores(df: DataFrame, label: str, prediction: str, split: str) -> DataFrame:
    """(split, support, accuracy, macro_f1), reading the rows once."""
    return _per_class(df, label, prediction, [split]).groupBy(split).agg(
        F.sum("true").cast("bigint").alias("support"), (F.sum("hit") / F.sum("true")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def evaluate(predictions: DataFrame, splits: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Report and accuracy for each split; a split without rows is an error."""
    kept = predictions.where(F.col("split").isin(*splits))
    present = {r["split"] for r in kept.select("split").distinct().collect()}
    missing = [s for s in splits if s not in present]
    if missing:
        raise ValueError(f"no rows for split: {', '.join(missing)}")
    scores = accuracy(kept, label, prediction, by=["split"]).select("split", "accuracy")
    return report(kept, label, prediction, by=["split"]).join(scores, "split")


def curve_summary(scores: DataFrame, size: str = "fraction") -> DataFrame:
    """Mean and population deviation over folds for every training size."""
    names = [c for c in ("train_acc", "val_acc", "train_f1", "val_f1") if c in scores.columns]
    return scores.groupBy(size).agg(
        F.count("*").alias("folds"),
        *[F.avg(c).alias(f"{c}_mean") for c in names],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in names],
    )


def fit_verdict(summary: DataFrame, size: str = "fraction", gap: float = 0.05, floor: float = 0.7) -> DataFrame:
    """Overfit, underfit or well fitted, judged at the largest training size."""
    acc_gap = F.col("train_acc_mean") - F.col("val_acc_mean")
    f1_gap = F.col("train_f1_mean") - F.col("val_f1_mean")
    last = summary.agg(F.max_by(F.struct(*[c for c in summary.columns if c != size]), size).alias("_last")).select("_last.*")
    verdict = (
        F.when((acc_gap > gap) | (f1_gap > gap), "overfit")
        .when((F.col("val_acc_mean") < floor) | (F.col("val_f1_mean") < floor), "underfit")
        .otherwise("well fitted")
    )
    return last.select(
        acc_gap.alias("acc_gap"), f1_gap.alias("f1_gap"), verdict.alias("verdict"),
        (((acc_gap > gap) | (f1_gap > gap)) & (f1_gap > acc_gap)).alias("class_balance_warning"),
    )


def final_gap(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Distance between validation and test accuracy, with a verdict."""

    def of(split: str) -> Column:
        right = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
        return F.avg(F.when(F.col("split") == split, right)).alias(f"{split}_accuracy")

    gap = F.abs(F.col("test_accuracy") - F.col("val_accuracy"))
    verdict = F.when(gap < 0.02, "good").when(gap < 0.05, "moderate").otherwise("poor")
    return predictions.agg(of("val"), of("test")).withColumn("gap", gap).withColumn("verdict", verdict)


def vote(predictions: Sequence[str]) -> Column:
    """The most frequent of several predictions, the smallest on a tie."""
    votes = F.array(*[F.col(p) for p in predictions])
    tally = F.transform(
        F.array_sort(F.array_distinct(votes)), lambda v: F.struct(F.size(F.filter(votes, lambda x: x == v)).alias("n"), v.alias("v"))
    )
    most = F.array_max(F.transform(tally, lambda t: t["n"]))
    return F.get(F.filter(tally, lambda t: t["n"] == most), F.lit(0))["v"]


def align(parts: Sequence[DataFrame], ids: Sequence[str]) -> DataFrame:
    """Predictions of several models for the rows all of them scored."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(ids))
    return out


def ensemble(df: DataFrame, predictions: Sequence[str], out: str = "ensemble") -> DataFrame:
    """Add the majority vote; a single model is passed through."""
    if not predictions:
        raise ValueError("no predictions to combine")
    return df.withColumn(out, vote(predictions) if len(predictions) > 1 else F.col(predictions[0]))


def method_accuracies(df: DataFrame, label: str, methods: Sequence[str]) -> DataFrame:
    """(method, accuracy) for several prediction columns, in one pass."""
    sums = df.agg(*[F.avg(F.when(F.col(label) == F.col(m), 1.0).otherwise(0.0)).alias(m) for m in methods])
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("accuracy")) for m in methods])
    return sums.select(F.inline(rows))


def compare_methods(df: DataFrame, label: str, methods: Sequence[str], combined: str = "ensemble") -> DataFrame:
    """Best method, its gain over the weakest single one, and the vote's benefit."""
    sums = df.agg(*[F.avg(F.when(F.col(label) == F.col(m), 1.0).otherwise(0.0)).alias(m) for m in [*methods, combined]])
    ranked = F.array(*[F.struct(F.col(m).alias("accuracy"), F.lit(-i).alias("no"), F.lit(m).alias("method"))
                       for i, m in enumerate([*methods, combined])])
    singles = [F.col(m) for m in methods]
    weakest = F.least(*singles) if len(singles) > 1 else singles[0]
    strongest = F.greatest(*singles) if len(singles) > 1 else singles[0]
    best = F.array_max(ranked)
    benefit = F.col(combined) - strongest
    return sums.select(
        best["method"].alias("best_method"), best["accuracy"].alias("best_accuracy"),
        weakest.alias("baseline"), (best["accuracy"] - weakest).alias("improvement"),
        ((best["accuracy"] - weakest) / F.nullif(weakest, F.lit(0.0)) * 100.0).alias("improvement_pct"),
        benefit.alias("ensemble_benefit"),
        F.when(benefit > 0.01, "meaningful").when(benefit > 0, "slight").otherwise("none").alias("benefit_verdict"),
    )


def best_by(df: DataFrame, metric: str, *keep: str) -> DataFrame:
    """The row with the greatest metric; the smallest ``keep`` values on a tie."""
    return df.orderBy(F.desc(metric), *keep).limit(1).select(*keep, metric)
