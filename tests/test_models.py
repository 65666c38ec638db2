import random
import statistics

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from threadloom.operators import features as ft, metrics as mt, models as md, profiling as pr, softmax, threads as th
from threadloom.session import small_side


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(3)
    kinds = {0: ["awful", "bad", "poor"], 1: ["table", "chair", "plain"], 2: ["great", "good", "fine"]}
    rows = []
    for i in range(240):
        label = i % 3
        words = rng.choices(kinds[label], k=6) + rng.choices(["the", "of", "day", "we"], k=4)
        rng.shuffle(words)
        rows.append((i, " ".join(words), float(label), "test" if i % 10 == 0 else "val" if i % 10 == 1 else "train"))
    return spark.createDataFrame(rows, "id long, text string, label double, split string").persist()


@pytest.fixture(scope="module")
def vectors(reviews):
    model = ft.fit_vectoriser(reviews.where("split = 'train'"), "text", 8, stop_words=["the"])
    return ft.vectorise(model, reviews).persist()


def test_models_learn_what_is_there(vectors):
    train, held_out = vectors.where("split = 'train'"), vectors.where("split <> 'train'")
    weighted = md.with_class_weights(train, "label")
    for model in (
        md.logistic_regression(weighted, max_iter=30, weight="weight"), md.naive_bayes(train),
        md.neural_net(train, 3, 8, hidden=(6,), max_iter=60),
    ):
        assert mt.accuracy(model.transform(held_out), "label", "prediction").first()["accuracy"] > 0.9


def test_score_gives_word_and_confidence(vectors):
    model = md.logistic_regression(vectors.where("split = 'train'"), max_iter=20)
    rows = md.score(model, vectors.select("id", "label", "features"), {"negative": 0, "neutral": 1, "positive": 2}).collect()
    right = sum(r["sentiment"] == ["negative", "neutral", "positive"][int(r["label"])] for r in rows)
    assert right / len(rows) > 0.9 and all(1 / 3 <= r["sent_score"] <= 1 for r in rows)


def test_vocabulary_is_frozen_and_vectors_have_length_one(spark, reviews):
    model = ft.fit_vectoriser(reviews, "text", 5, ngrams=2, stop_words=["the"])
    assert len(ft.vocabulary_of(model)) == 5
    other = spark.createDataFrame([("awful awful unseen words",), (None,)], "text string")
    lengths = [np.linalg.norm(r[0]) for r in ft.vectorise(model, other).select(vector_to_array("features")).collect()]
    assert all(abs(x - 1) < 1e-9 or x == 0 for x in lengths)


def test_boosted_terms_weigh_more(spark, reviews):
    model = ft.fit_vectoriser(reviews, "text", 5, stop_words=["the"])
    first = ft.vocabulary_of(model)[0]
    boosts = spark.createDataFrame([(first, 3.0), (first, 2.0), ("unknown", 9.0), (ft.vocabulary_of(model)[1], None)], "term string, factor double")
    plain, more = (ft.vectorise(m, reviews).select(vector_to_array("features")).collect() for m in (model, ft.boosted(model, boosts)))
    for (a,), (b,) in zip(plain, more):
        scaled = np.array(a) * [3.0, 1, 1, 1, 1]
        assert b == pytest.approx(scaled / (np.linalg.norm(scaled) or 1))


def test_sweep_curve_and_adaptation_run(reviews, vectors):
    train, val = reviews.where("split = 'train'"), reviews.where("split = 'val'")
    sweep, fitted = md.vocabulary_sweep(train, val, [3, 12], 3)
    rows = {r["matrix_columns"]: r for r in sweep.collect()}
    assert set(rows) == {3, 12} and rows[12]["accuracy"] > 0.9 and rows[12]["matrix_rows"] == train.count()
    assert all(fits.converged() for _, fits in fitted)
    # A start from the smaller vocabulary ends where any other start does.
    fresh = softmax.fit(fitted[1][0], 12, 3)
    assert fresh.losses[0] == pytest.approx(fitted[1][1].losses[0], abs=1e-9)
    curve = md.learning_curve(
        vectors.where("split = 'train'").select("id", "label", "features"), ["id"],
        lambda rows: md.logistic_regression(rows, max_iter=5), ["1/2", "1"], k=2,
    )
    assert sorted((r["fold"], r["fraction"]) for r in curve.collect()) == [(0, 0.5), (0, 1.0), (1, 0.5), (1, 1.0)]
    verdict = mt.fit_verdict(mt.curve_summary(curve)).first()
    assert verdict["verdict"] in {"overfit", "underfit", "well fitted"}
    parts = [vectors.where(f"split = '{s}'").select("id", "label", "features") for s in ("train", "val", "train", "test")]
    assert -1 <= md.adapt_by_refit(*parts, 3)[2].first()["gain"] <= 1


def test_sizes_of_a_sweep_share_their_scans(reviews, monkeypatch):
    asked, scan = [], softmax.losses_and_gradients
    monkeypatch.setattr(softmax, "losses_and_gradients", lambda blocks, points, *rest: asked.append(len(points)) or scan(blocks, points, *rest))
    train, val = reviews.where("split = 'train'"), reviews.where("split = 'val'")
    sizes = [3, 6, 12]
    _, fitted = md.vocabulary_sweep(train, val, sizes, 3)
    assert asked[0] == 3 and len(asked) < 2 * max(fits.iterations[0] for _, fits in fitted)
    for size, (blocks, fits) in zip(sizes, fitted):
        # The same optimum as that of vectors of the smaller vocabulary.
        own = ft.vectorise(ft.fit_vectoriser(train, "text", size, stop_words=()), train)
        alone = softmax.fit(softmax.blocked(own, "label", "features"), size, 3)
        assert fits.converged() and fits.coefficients[0].shape == (size + 1, 3)
        assert fits.losses[0] == pytest.approx(alone.losses[0], abs=1e-9)
        ((fitted_moment, observed),) = softmax.moments(blocks, fits)
        assert np.abs(fitted_moment - observed).max() < 1e-6 * observed[-1].sum()


def test_refit_starts_where_the_base_model_ended(vectors):
    train, val = vectors.where("split = 'train'"), vectors.where("split = 'val'")
    base, refit, _ = md.adapt_by_refit(train, val, train, val, 3)
    assert base.converged() and refit.converged() and base.iterations[0] > 3 and refit.iterations == [0]
    base, refit, scores = md.adapt_by_refit(train, val, train.where("false"), val, 3)
    assert np.array_equal(base.coefficients[0], refit.coefficients[0]) and scores.first()["gain"] == 0
    blocks = softmax.blocked(train.where("id % 4 = 0"), "label", "features")
    cold, warm = softmax.fit(blocks, 8, 3), softmax.fit(blocks, 8, 3, start=base.coefficients)
    assert warm.losses[0] == pytest.approx(cold.losses[0], abs=1e-10)


def plain_loss(rows, point, c):
    """The objective row by row."""
    total = sum(w for _, _, w in rows)
    loss = 0.0
    for label, x, w in rows:
        margins = x @ point[:-1] + point[-1]
        loss += w * (np.log(np.exp(margins - margins.max()).sum()) + margins.max() - margins[label])
    return (loss + (point[:-1] ** 2).sum() / (2 * c)) / total


def test_blocks_are_bounded(monkeypatch):
    starts, places = np.arange(0, 101) * 5, np.arange(500)
    assert softmax.borders(starts, places) == [(0, 100)]
    monkeypatch.setattr(softmax, "BLOCK_ROWS", 17)
    assert [hi - lo for lo, hi in softmax.borders(starts, places)] == [17] * 5 + [15]
    monkeypatch.setattr(softmax, "BLOCK_CELLS", 100)
    found = softmax.borders(starts, places)
    assert found[0][0] == 0 and found[-1][1] == 100 and all((hi - lo) ** 2 * 5 <= 100 for lo, hi in found)


def test_fits_are_optimal_and_share_a_scan(spark, vectors):
    weights = F.array(F.lit(1.0), F.when(F.col("id") % 3 == 0, 2.0).otherwise(0.5), F.when(F.col("id") < 30, 1.0).otherwise(0.0), F.lit(0.0))
    blocks = softmax.blocked(vectors.repartition(3), "label", "features", weights)
    assert blocks.agg(F.sum("n")).first()[0] == vectors.count() and blocks.count() == 3
    fits = softmax.fit(blocks, 8, 3, c=0.5)
    assert fits.converged() and fits.iterations[3] == 0
    collected = [(int(r.label), r.features.toArray(), r.id) for r in vectors.collect()]
    own = [lambda i: 1.0, lambda i: 2.0 if i % 3 == 0 else 0.5, lambda i: float(i < 30)]
    rng = np.random.default_rng(0)
    for m, weight in enumerate(own):
        rows = [(label, x, weight(i)) for label, x, i in collected if weight(i)]
        best = plain_loss(rows, fits.coefficients[m], 0.5)
        assert best == pytest.approx(fits.losses[m], abs=1e-12)
        assert all(plain_loss(rows, fits.coefficients[m] + 1e-3 * rng.normal(size=(9, 3)), 0.5) > best for _ in range(20))
    ((fitted, observed), *_) = softmax.moments(blocks, fits, 0.5)
    assert np.abs(fitted - observed).max() <= 1e-6 * observed[-1].sum()


def test_fit_agrees_with_the_public_estimator(vectors):
    train = vectors.where("split = 'train'")
    public = md.logistic_regression(train, max_iter=1000)
    public_coefficients = np.vstack([public.coefficientMatrix.toArray().T, public.interceptVector.toArray()])
    fits = softmax.fit(softmax.blocked(train, "label", "features"), 8, 3)
    # Intercepts are free up to a constant.
    public_coefficients[-1] -= public_coefficients[-1].mean()
    own = fits.coefficients[0].copy()
    own[-1] -= own[-1].mean()
    assert own == pytest.approx(public_coefficients, abs=2e-3)
    both = public.transform(vectors).withColumn("own", softmax.predictions("features", fits.coefficients)[0])
    assert both.where("own <> prediction").count() == 0
    near = both.select(vector_to_array("probability").alias("a"), softmax.class_probabilities("features", fits.coefficients).alias("b"))
    assert all(r.a == pytest.approx(r.b, abs=2e-3) for r in near.collect())


def test_curve_in_one_pass_has_the_scores_of_single_fits(vectors):
    train = vectors.where("split = 'train'").select("id", "label", "features")

    class Fitted:
        """A model of one's own fit, as the curve of single fits takes it."""

        def __init__(self, rows):
            self.fits = softmax.fit(softmax.blocked(rows, "label", "features"), 8, 3)

        def transform(self, rows):
            return rows.withColumn("prediction", softmax.predictions("features", self.fits.coefficients)[0])

    single = md.learning_curve(train, ["id"], Fitted, ["1/4", "1"], k=2)
    together, _, fits = md.curve_in_one_pass(train, ["id"], ["1/4", "1"], 2, 3)
    assert fits.converged() and len(fits.losses) == 4
    assert sorted(map(tuple, together.collect())) == [pytest.approx(r) for r in sorted(map(tuple, single.select(together.columns).collect()))]


def test_terms_that_occur_together_cost_few_passes(spark):
    # Pairs of terms that nearly always come together bend the loss in narrow valleys.
    rng = random.Random(11)
    rows = []
    for i in range(600):
        values = {}
        for at in range(0, 30, 2):
            amount = rng.random() ** 4
            values[at], values[at + 1] = amount, amount + 0.01 * rng.random()
        rows.append((float(rng.random() < sum(values.values()) / 8), Vectors.sparse(30, values)))
    df = spark.createDataFrame(rows, StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    blocks = softmax.blocked(df.repartition(3), "label", "features", F.array(F.lit(100.0)))
    fits = softmax.fit(blocks, 30, 2)
    assert fits.converged() and fits.iterations[0] <= 20


def test_terms_behind_the_heaviest_keep_their_own_curvature(vectors, monkeypatch):
    blocks = softmax.blocked(vectors, "label", "features")
    every = softmax.fit(blocks, 8, 3)
    monkeypatch.setattr(softmax, "HEAD", 3)
    some = softmax.fit(blocks, 8, 3)
    assert some.converged() and some.losses[0] == pytest.approx(every.losses[0], abs=1e-10)


def test_rows_without_terms_and_dense_vectors(spark):
    rows = [(0.0, Vectors.dense([0.0, 0.0])), (1.0, Vectors.sparse(2, [], [])), (0.0, Vectors.dense([1.0, 0.0])), (None, Vectors.dense([1.0, 0.0]))]
    df = spark.createDataFrame(rows, StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    fits = softmax.fit(softmax.blocked(df, "label", "features"), 2, 2)
    assert fits.converged() and df.select(softmax.predictions("features", fits.coefficients)[0]).count() == 4
    nothing = softmax.blocked(df.where("false"), "label", "features")
    assert softmax.fit(nothing, 2, 2, start=fits.coefficients).coefficients[0] is fits.coefficients[0]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(0, 0, 0, "train"), (1, 0, 1, "train"), (2, 1, 1, "train"), (3, 2, 1, "test"), (4, 2, 0, "test")]
    return spark.createDataFrame(rows, "id long, label int, prediction int, split string")


def test_report_with_a_class_never_predicted(scored):
    rows = {r["label"]: r for r in mt.report(scored, "label", "prediction").collect()}
    assert (rows["2"]["precision"], rows["2"]["recall"], rows["2"]["f1"], rows["2"]["support"]) == (0, 0, 0, 2)
    assert rows["1"]["precision"] == pytest.approx(1 / 3) and rows["1"]["recall"] == 1
    assert rows["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx((0.5 * 2 + 1 + 0) / 5)


def test_missing_split_raises(scored):
    with pytest.raises(ValueError, match="dev"):
        mt.evaluate(scored, ["train", "dev"])


def test_votes(spark):
    rows = [(1, 1, 2), (2, 1, 0), (0, 2, 2), (2, 2, 2)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    assert [r["ensemble"] for r in mt.ensemble(df, ["a", "b", "c"]).collect()] == [1, 0, 2, 2]
    assert [r["ensemble"] for r in mt.ensemble(df, ["a"]).collect()] == [1, 2, 0, 2]
    with pytest.raises(ValueError):
        mt.ensemble(df, [])


def test_alignment_keeps_common_rows(spark):
    parts = [spark.createDataFrame([(i, i) for i in ids], f"id int, m{n} int") for n, ids in enumerate(([1, 2, 3], [2, 3], [3, 2, 9]))]
    assert sorted(r["id"] for r in mt.align(parts, ["id"]).collect()) == [2, 3]


@pytest.mark.parametrize("max_rows", [10, 100_000])
def test_exact_quantiles(spark, max_rows):
    rng = random.Random(5)
    # A third of the values are equal; the rest are heavy-tailed.
    values = [7.0] * 2000 + [rng.paretovariate(0.7) for _ in range(4001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(6)
    got = pr.exact_quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0], max_rows)
    assert got == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0])), rel=1e-12)
    row = pr.describe(df, "v").first()
    assert row["count"] == 6001 and row["std"] == pytest.approx(statistics.stdev(values))


def test_no_values_no_quantiles(spark):
    assert pr.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_ties_and_hot_parents(spark):
    rows = [(f"c{i:05d}", "hot" if i % 3 == 0 else f"p{i}", f"b{i}", 5, i % 7) for i in range(9000)]
    comments = spark.createDataFrame(rows, "id string, post_id string, body string, score long, created_ts long").repartition(8)
    out = th.joined_children(th.top_children(comments, 3), 3, " ").where("post_id = 'hot'").first()
    hot = sorted((r[4], r[0], r[2]) for r in rows if r[1] == "hot")[:3]
    assert out["children"] == " ".join(b for _, _, b in hot)


def test_a_lookup_past_its_bound_is_not_broadcast(spark):
    small, big = small_side(spark.range(5), 10), small_side(spark.range(50), 10)
    left = spark.range(100)
    plans = [left.join(side, "id")._jdf.queryExecution().optimizedPlan().toString() for side in (small, big)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]
    assert left.join(big, "id").count() == 50


def test_confusion_matrix_keeps_zeros(scored):
    rows = {(r["label"], r["prediction"]): r["n"] for r in mt.confusion_matrix(scored, "label", "prediction", [0, 1, 2, 3]).collect()}
    assert len(rows) == 16 and rows[(3, 3)] == 0 and rows[(2, 1)] == 1
    assert mt.confusion_matrix(scored, "label", "prediction", list(range(1_001))).count() == 1_001**2


def test_empty_report_grid(scored):
    assert scored.where(F.lit(False)).transform(lambda d: mt.report(d, "label", "prediction")).count() == 0
