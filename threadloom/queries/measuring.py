"""Evaluation of predictions, votes and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.hashing import hash_bucket
from threadloom.operators import metrics as mt
from threadloom.queries import standins as st
from threadloom.queries.registry import query

MODELS = list(st.MODELS)


def report_sql(by: str = "") -> str:
    """Rows of the per-class report with both averages, optionally per split."""
    lead, cols, on = (f"{by}, ", f"{by}, ", f"AND t.{by} = c.{by}") if by else ("", "", "")
    group = f"GROUP BY {by}" if by else ""
    c_by = f"c.{by}, " if by else ""
    return f"""classes AS (SELECT {lead}label::VARCHAR AS class FROM predictions UNION SELECT {lead}model_a::VARCHAR FROM predictions),
per AS (
  SELECT {c_by}c.class, count(*) FILTER (t.label::VARCHAR = c.class)::DOUBLE AS support,
         count(*) FILTER (t.model_a::VARCHAR = c.class)::DOUBLE AS said,
         count(*) FILTER (t.label::VARCHAR = c.class AND t.model_a::VARCHAR = c.class)::DOUBLE AS hit
  FROM classes c JOIN predictions t ON (t.label::VARCHAR = c.class OR t.model_a::VARCHAR = c.class) {on} GROUP BY ALL),
pr AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM per),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr),
report AS (
  SELECT {cols}class AS label, p AS precision, r AS recall, f1, support FROM f
  UNION ALL SELECT {cols}'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f {group}
  UNION ALL SELECT {cols}'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM f {group})"""


ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support"


def _rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


@query("metric_accuracy", f"WITH {st.PREDICTIONS} SELECT count(*) AS support, round(avg((label = model_a)::INT), 6) AS accuracy FROM predictions")
def metric_accuracy(spark, sf):
    return _rounded(mt.accuracy(st.predictions(spark, sf), "label", "model_a"), "accuracy")


@query("metric_report", f"WITH {st.PREDICTIONS}, {report_sql()} SELECT label, {ROUNDED} FROM report")
def metric_report(spark, sf):
    return _rounded(mt.report(st.predictions(spark, sf), "label", "model_a"), "precision", "recall", "f1")


@query("metric_confusion", f"""WITH {st.PREDICTIONS}, grid AS (SELECT unnest(range(0, 11))::INT AS label), others AS (SELECT label AS prediction FROM grid)
SELECT g.label, o.prediction, count(p.vec_id) AS n FROM grid g CROSS JOIN others o
LEFT JOIN predictions p ON p.label = g.label AND p.model_a = o.prediction GROUP BY ALL""")
def metric_confusion(spark, sf):
    # Class 10 never occurs; its zero row and column must be there all the same.
    return mt.confusion_matrix(st.predictions(spark, sf), "label", "model_a", list(range(11)))


@query("metric_macro_f1", f"WITH {st.PREDICTIONS}, {report_sql()} SELECT round(avg(f1), 6) AS macro_f1 FROM f")
def metric_macro_f1(spark, sf):
    return _rounded(mt.macro_f1(st.predictions(spark, sf), "label", "model_a"), "macro_f1")


@query("eval_by_split", f"""WITH {st.PREDICTIONS}, {report_sql('split')},
acc AS (SELECT split, round(avg((label = model_a)::INT), 6) AS accuracy FROM predictions GROUP BY split)
SELECT split, label, {ROUNDED}, accuracy FROM report JOIN acc USING (split)""")
def eval_by_split(spark, sf):
    out = mt.evaluate(st.predictions(spark, sf), ["train", "dev", "test"], "label", "model_a")
    return _rounded(out, "precision", "recall", "f1", "accuracy")


# Scores of five folds and four growing subsets, made from the predictions.
CURVE = f"""{st.PREDICTIONS}, steps AS (SELECT unnest(range(1, 5)) AS step),
scores AS (SELECT {st.bucket_sql('vec_id::VARCHAR', 5, 'fold')} AS fold, step / 4.0::DOUBLE AS fraction,
    avg((label = model_a)::INT) AS train_acc, avg((label = model_b)::INT) AS val_acc,
    avg((label = model_b)::INT) AS train_f1, avg((label = model_c)::INT) AS val_f1
  FROM predictions JOIN steps ON {st.bucket_sql('vec_id::VARCHAR', 4, 'step')} < step GROUP BY ALL),
summary AS (SELECT fraction, count(*) AS folds, {', '.join(
    f"{f}({c}) AS {c}_{n}" for f, n in (('avg', 'mean'), ('stddev_pop', 'std')) for c in ('train_acc', 'val_acc', 'train_f1', 'val_f1'))}
  FROM scores GROUP BY fraction)"""
MEASURES = [f"{c}_{n}" for n in ("mean", "std") for c in ("train_acc", "val_acc", "train_f1", "val_f1")]


def _summary(spark, sf):
    rows = st.predictions(spark, sf)
    step = hash_bucket("vec_id", buckets=4, seed="step").cast("int") + 1
    right = [F.avg((F.col("label") == F.col(m)).cast("int")) for m in MODELS]
    scores = (
        rows.withColumn("fold", hash_bucket("vec_id", buckets=5, seed="fold"))
        .withColumn("fraction", F.explode(F.transform(F.sequence(step, F.lit(4)), lambda s: s / F.lit(4.0))))
        .groupBy("fold", "fraction")
        .agg(right[0].alias("train_acc"), right[1].alias("val_acc"), right[1].alias("train_f1"), right[2].alias("val_f1"))
    )
    return mt.curve_summary(scores)


@query("curve_summary", f"WITH {CURVE} SELECT fraction, folds, {', '.join(f'round({m}, 6) AS {m}' for m in MEASURES)} FROM summary")
def curve_summary(spark, sf):
    return _rounded(_summary(spark, sf), *MEASURES)


@query("fit_verdict", f"""WITH {CURVE}, last AS (SELECT train_acc_mean - val_acc_mean AS a, train_f1_mean - val_f1_mean AS f, val_acc_mean AS va, val_f1_mean AS vf
  FROM summary WHERE fraction = 1)
SELECT round(a, 6) AS acc_gap, round(f, 6) AS f1_gap,
       CASE WHEN a > 0.05 OR f > 0.05 THEN 'overfit' WHEN va < 0.7 OR vf < 0.7 THEN 'underfit' ELSE 'well fitted' END AS verdict,
       (a > 0.05 OR f > 0.05) AND f > a AS class_balance_warning FROM last""")
def fit_verdict(spark, sf):
    return _rounded(mt.fit_verdict(_summary(spark, sf)), "acc_gap", "f1_gap")


VOTED = f"""{st.PREDICTIONS}, votes AS (SELECT vec_id, unnest([model_a, model_b, model_c]) AS v FROM predictions),
tally AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, v) AS place FROM votes GROUP BY vec_id, v),
voted AS (SELECT p.*, t.v AS ensemble FROM predictions p JOIN tally t ON p.vec_id = t.vec_id AND place = 1)"""


def _voted(spark, sf):
    rows = st.predictions(spark, sf)
    parts = [rows.select("vec_id", "label", MODELS[0]), *[rows.select("vec_id", m) for m in MODELS[1:]]]
    return mt.ensemble(mt.align(parts, ["vec_id"]), MODELS)


@query("ensemble_vote", f"WITH {VOTED} SELECT vec_id, label, model_a, model_b, model_c, ensemble FROM voted")
def ensemble_vote(spark, sf):
    return _voted(spark, sf)


METHODS = [*MODELS, "ensemble"]
ACCURACIES = f"""{VOTED}, acc AS (SELECT {', '.join(f'avg((label = {m})::INT) AS {m}' for m in METHODS)} FROM voted)"""


@query("method_accuracies", f"WITH {ACCURACIES} " + " UNION ALL ".join(f"SELECT '{m}' AS method, round({m}, 6) AS accuracy FROM acc" for m in METHODS))
def method_accuracies(spark, sf):
    return _rounded(mt.method_accuracies(_voted(spark, sf), "label", METHODS), "accuracy")


@query("compare_methods", f"""WITH {ACCURACIES}, best AS (SELECT *, greatest(model_a, model_b, model_c) AS top, least(model_a, model_b, model_c) AS low,
  greatest(model_a, model_b, model_c, ensemble) AS overall FROM acc)
SELECT CASE WHEN model_a = overall THEN 'model_a' WHEN model_b = overall THEN 'model_b' WHEN model_c = overall THEN 'model_c' ELSE 'ensemble' END AS best_method,
       round(overall, 6) AS best_accuracy, round(low, 6) AS baseline, round(overall - low, 6) AS improvement,
       round((overall - low) / low * 100, 6) AS improvement_pct, round(ensemble - top, 6) AS ensemble_benefit,
       CASE WHEN ensemble - top > 0.01 THEN 'meaningful' WHEN ensemble - top > 0 THEN 'slight' ELSE 'none' END AS benefit_verdict FROM best""")
def compare_methods(spark, sf):
    out = mt.compare_methods(_voted(spark, sf), "label", MODELS)
    return _rounded(out, "best_accuracy", "baseline", "improvement", "improvement_pct", "ensemble_benefit")


@query("best_candidate", f"WITH {ACCURACIES}, rows AS ({' UNION ALL '.join(f'SELECT {m!r} AS method, round({m}, 6) AS accuracy FROM acc' for m in METHODS)}) SELECT * FROM rows ORDER BY accuracy DESC, method LIMIT 1")
def best_candidate(spark, sf):
    return mt.best_by(method_accuracies(spark, sf), "accuracy", "method")


@query("final_gap", f"""WITH {st.PREDICTIONS}, a AS (SELECT avg((label = model_a)::INT) FILTER (split = 'dev') AS v,
  avg((label = model_a)::INT) FILTER (split = 'test') AS t FROM predictions)
SELECT round(v, 6) AS val_accuracy, round(t, 6) AS test_accuracy, round(abs(t - v), 6) AS gap,
       CASE WHEN abs(t - v) < 0.02 THEN 'good' WHEN abs(t - v) < 0.05 THEN 'moderate' ELSE 'poor' END AS verdict FROM a""")
def final_gap(spark, sf):
    rows = st.predictions(spark, sf).withColumn("split", F.when(F.col("split") == "dev", "val").otherwise(F.col("split")))
    return _rounded(mt.final_gap(rows, "label", "model_a"), "val_accuracy", "test_accuracy", "gap")
