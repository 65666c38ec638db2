"""Multinomial regression fitted to its optimum, many models at a time, from any start.

The public estimator takes no start and stops by iterations. Here rows are put
into blocks once (``blocked``); each pass reads them, gives every task the present
coefficients of all unfinished models, and sums the tasks' gradients in slices.
A row counts for each model with a weight of its own, so models on subsets of
the rows (folds, fractions) share one scan. The optimiser of a model is a
generator that asks for the loss and gradient at a point; it ends when no entry
of the gradient of its mean loss is larger than the tolerance.

The objective of a model is ``sum(w loss) / sum(w) + |coefficients|^2 / (2 C sum(w))``,
with free intercepts. At its optimum each term's fitted moment, the sum of
``w x p`` plus ``coefficient / C``, is its observed one, the sum of ``w x`` over
the rows of the class: ``moments`` returns both.

The curvature has one bound at every point: a quarter of the rows' mean products
of terms, plus the penalty. One more scan (``metric``) sums these products over
all rows, for the ``HEAD`` heaviest terms in full and for the others their
squares; its inverse turns gradients into steps. Terms that occur together then
cost few more passes than terms that don't. It is only the metric of the steps:
where a fit ends is fixed by the gradient over all rows. Models may also
have vocabularies of unlike size, each the head of the next (``heads``); rows then
have a scale for each, and the models share scans and the table.

What the driver holds grows with terms, classes and models only; the metric has
at most ``HEAD`` squared entries.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from threadloom.session import settle

# Rows and cells (rows times the terms they have) of a block.
BLOCK_ROWS = 1024
BLOCK_CELLS = 4_000_000
# Curvature pairs kept for each model.
MEMORY = 10
# Tasks that sum a gradient, each its share of the terms, if the scan's tasks have more than so many values for the driver.
SLICES = 8
DRIVER_VALUES = 4_000_000
# Columns up to which products with a block go cell by cell; for more a dense block is faster.
FEW_COLUMNS = 64
# Terms at most whose products are summed (100 MB for 5,000), and the tasks that sum them, one such table each.
HEAD = 5_000
METRIC_TASKS = 16
METRIC_SLICES = 32
TOLERANCE = 1e-7
MAX_ITERATIONS = 1_000

BLOCK = "n int, labels binary, weights binary, terms binary, starts binary, places binary, amounts binary, scales binary"


@dataclass
class Metric:
    """Inverse of the products of some terms, the heaviest, and of the intercept, all scaled to squares of one."""

    terms: np.ndarray
    inverse: np.ndarray


@dataclass
class Fits:
    """Coefficients of models by term and class; the last row holds the intercepts."""

    coefficients: list[np.ndarray]
    gradient_norms: list[float]
    iterations: list[int]
    losses: list[float]
    # From the first scan until the model's fit ended.
    seconds: list[float] = field(default_factory=list)

    def of_head(self, at: int, head: int) -> Fits:
        """The model number ``at`` alone, without the coefficients behind its head."""
        point = self.coefficients[at]
        parts = (self.gradient_norms, self.iterations, self.losses, self.seconds)
        return Fits([np.concatenate([point[:head], point[-1:]])], *[[p[at]] for p in parts])

    def converged(self, tolerance: float = TOLERANCE) -> bool:
        return all(norm <= tolerance for norm in self.gradient_norms)


def sparse(features: str) -> Column:
    """The places and amounts of a feature vector."""
    vector = F.unwrap_udt(features)
    every = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    places = F.coalesce(vector["indices"], F.when(F.size(vector["values"]) > 0, every).otherwise(F.array().cast("array<int>")))
    return F.struct(places.alias("places"), vector["values"].alias("amounts"))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists of a column start in their flat values (with the end), and the values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten().to_numpy(zero_copy_only=False)


def head_scales(starts: np.ndarray, places: np.ndarray, amounts: np.ndarray, heads: Sequence[int]) -> np.ndarray:
    """Rows by heads: what brings the amounts at the first so many places to length one."""
    n, cells = len(starts) - 1, np.diff(starts)
    rows = np.repeat(np.arange(n), cells)
    squares = np.stack([np.bincount(rows, amounts**2 * (places < head), n) for head in heads], 1)
    return 1 / np.sqrt(np.where(squares > 0, squares, 1.0))


def blocked(rows: DataFrame, label: str, features: str, weights: Column | None = None, heads: Sequence[int] = ()) -> DataFrame:
    """Rows as settled blocks; ``weights`` is an array with the row's weight in each model.

    ``heads`` gives a model to each so many first terms; a row's amounts at them, brought to length one, are its features there.
    Rows without a weight in any model, or without a label, are left out.
    """
    own = weights if weights is not None else F.array(*[F.lit(1.0)] * max(len(heads), 1))
    columns = rows.select(F.col(label).cast("int").alias("label"), own.cast("array<double>").alias("weights"), sparse(features).alias("x"))
    columns = columns.select("label", "weights", "x.places", "x.amounts")
    columns = columns.where(F.col("label").isNotNull() & F.exists("weights", lambda w: w > 0))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            _, flat = list_parts(batch.column(1))
            weights = flat.reshape(len(labels), -1)
            starts, places = list_parts(batch.column(2))
            _, amounts = list_parts(batch.column(3))
            scales = head_scales(starts, places, amounts, heads) if heads else np.zeros((len(labels), 0))
            # Vocabularies of many sizes go with few columns, so their blocks are never dense.
            for lo, hi in borders(starts, places, dense=not heads):
                inside = slice(starts[lo], starts[hi])
                terms, own = np.unique(places[inside], return_inverse=True)
                cells = [
                    labels[lo:hi], weights[lo:hi].astype("<f8"), terms.astype("<i4"), (starts[lo : hi + 1] - starts[lo]).astype("<i8"),
                    own.astype("<i4"), amounts[inside].astype("<f8"), scales[lo:hi],
                ]
                yield block_row(hi - lo, cells)

    return settle(columns.mapInArrow(tasks, BLOCK), "blocks")


def block_row(n: int, cells: Sequence[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array([n], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCK.split(", ")])


def of_head(blocks: DataFrame, at: int, head: int) -> DataFrame:
    """The blocks of the model number ``at`` alone, whose vocabulary is the first ``head`` terms."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches):
            kept = block.places < np.searchsorted(block.terms, head)
            starts = np.concatenate([[0], np.cumsum(kept)])[block.starts].astype("<i8")
            amounts = (block.amounts * block.scales[block.rows, at])[kept]
            none = np.zeros((block.n, 0))
            cells = [block.labels, block.weights[:, at], block.terms[block.terms < head], starts, block.places[kept], amounts, none]
            yield block_row(block.n, cells)

    return blocks.mapInArrow(tasks, BLOCK)


def borders(starts: np.ndarray, places: np.ndarray, dense: bool = True) -> list[tuple[int, int]]:
    """Row ranges of blocks whose cells stay in bounds, ``dense`` rows times terms, else those that rows have; a row has at most as many terms as places."""
    found, lo, n = [], 0, len(starts) - 1
    while lo < n:
        hi = min(lo + BLOCK_ROWS, n)
        while hi - lo > 1 and ((hi - lo) * len(np.unique(places[starts[lo] : starts[hi]])) if dense else starts[hi] - starts[lo]) > BLOCK_CELLS:
            hi = lo + (hi - lo) // 2
        found.append((lo, hi))
        lo = hi
    return found


class Block:
    def __init__(self, row: dict) -> None:
        n = self.n = row["n"]
        self.labels = np.frombuffer(row["labels"], "<i4")
        self.weights = np.frombuffer(row["weights"], "<f8").reshape(n, -1)
        self.terms = np.frombuffer(row["terms"], "<i4")
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.places = np.frombuffer(row["places"], "<i4")
        self.amounts = np.frombuffer(row["amounts"], "<f8")
        # What a model's amounts are multiplied by.
        scales = np.frombuffer(row["scales"], "<f8").reshape(n, -1)
        self.scales = scales if scales.shape[1] else np.ones_like(self.weights)

    @cached_property
    def rows(self) -> np.ndarray:
        """The row of each cell."""
        return np.repeat(np.arange(self.n), np.diff(self.starts))

    @cached_property
    def dense(self) -> np.ndarray:
        """Rows by the block's own terms."""
        x = np.zeros((self.n, len(self.terms)))
        # A row has a term once.
        x[self.rows, self.places] = self.amounts
        return x

    def times(self, values: np.ndarray) -> np.ndarray:
        """Rows by columns, from values of the block's own terms by columns."""
        if values.shape[1] > FEW_COLUMNS and self.n * len(self.terms) <= BLOCK_CELLS:
            return self.dense @ values
        out, filled = np.zeros((self.n, values.shape[1])), np.flatnonzero(np.diff(self.starts))
        for k, column in enumerate(np.ascontiguousarray(values.T) if len(filled) else ()):
            out[filled, k] = np.add.reduceat(self.amounts * column[self.places], self.starts[filled])
        return out

    def turned(self, values: np.ndarray, power: int = 1) -> np.ndarray:
        """The block's own terms by columns, from values of its rows by columns; ``power`` is that of the amounts."""
        if values.shape[1] > FEW_COLUMNS and self.n * len(self.terms) <= BLOCK_CELLS:
            return (self.dense**power).T @ values
        amounts, cells = self.amounts**power, np.diff(self.starts)
        return np.stack([np.bincount(self.places, amounts * np.repeat(c, cells), len(self.terms)) for c in values.T], 1)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def summed(blocks: DataFrame, part, n_terms: int, width: int) -> np.ndarray:
    """The sum over all blocks of ``part(block)``: values of the block's terms and of one row for the intercept.

    A task adds up its own blocks, one for each core; their sums meet in slices of the terms, or if they are few on the driver.
    """
    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    direct = tasks * (n_terms + 1) * width <= DRIVER_VALUES
    n_slices = 1 if direct else SLICES
    edges = np.linspace(0, n_terms + 1, n_slices + 1).astype(int)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks_of(batches):
            total = np.zeros((n_terms + 1, width)) if total is None else total
            of_terms, of_all = part(block)
            total[block.terms] += of_terms
            total[-1] += of_all
        if total is not None:
            values = [total[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_slices), pa.int32()), pa.array(values, pa.binary())], ["slice", "value"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(value.as_buffer(), "<f8")
                sums[at] = sums[at] + own if at in sums else own.copy()
        values = pa.array([v.tobytes() for v in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), values], ["slice", "value"])

    kind = "slice int, value binary"
    sums = blocks.coalesce(tasks).mapInArrow(partial, kind)
    sums = sums if direct else sums.repartition(SLICES, "slice").mapInArrow(whole, kind)
    total = np.zeros((n_terms + 1, width))
    for row in sums.collect():
        total[edges[row["slice"]] : edges[row["slice"] + 1]] += np.frombuffer(row["value"], "<f8").reshape(-1, width)
    return total


def metric(blocks: DataFrame, share: np.ndarray, mean: np.ndarray, bound: np.ndarray, width: int) -> Metric:
    """The metric of the ``width`` terms with the largest mean squares ``mean``; ``share`` is what a model's weights count in the mean.

    All models have these terms.

    A task adds up the products of its own rows; they meet in slices of the lower triangle.
    """
    terms = np.sort(np.argsort(-mean[:-1], kind="stable")[:width])
    place = np.full(len(mean), -1)
    place[terms] = np.arange(width)
    edges = np.unique(np.linspace(0, width + 1, METRIC_SLICES + 1).astype(int))
    parts = [*zip(edges, edges[1:])]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks_of(batches):
            total = np.zeros((width + 1, width + 1), np.float32) if total is None else total
            own = place[block.terms][block.places]
            x = np.zeros((block.n, width + 1), np.float32)
            x[block.rows[own >= 0], own[own >= 0]] = block.amounts[own >= 0]
            x *= np.sqrt((block.weights * block.scales**2) @ share)[:, None]
            x[:, -1] = np.sqrt(block.weights @ share)
            for a, b in parts:
                total[a:b, :b] += x[:, a:b].T @ x[:, :b]
        if total is not None:
            for at, (a, b) in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[a:b, :b].tobytes()], pa.binary())], ["slice", "value"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(value.as_buffer(), "<f4")
                sums[at] = sums[at] + own if at in sums else own.copy()
        for at, value in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([value.tobytes()], pa.binary())], ["slice", "value"])

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((width + 1, width + 1), np.float32)
        for batch in batches:
            for at, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = parts[at]
                products[a:b, :b] = np.frombuffer(value.as_buffer(), "<f4").reshape(b - a, b)
                products[:a, a:b] = products[a:b, :a].T
        products *= scale[:, None] / 4
        products *= scale
        products[np.diag_indices(width + 1)] = 1 + 1e-4
        own = np.linalg.inv(products)
        for at, (a, b) in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([own[a:b].tobytes()], pa.binary())], ["slice", "value"])

    # Scaled by its diagonal the table has entries of like size, which single precision holds.
    scale = (1 / np.sqrt(bound[np.append(terms, len(mean) - 1)])).astype(np.float32)
    kind = "slice int, value binary"
    sums = blocks.coalesce(METRIC_TASKS).mapInArrow(partial, kind).repartition(len(parts), "slice").mapInArrow(whole, kind)
    inverse = np.zeros((width + 1, width + 1), np.float32)
    # The table is as big for any number of rows; one task inverts it.
    for row in sums.repartition(1).mapInArrow(inverted, kind).toLocalIterator():
        a, b = parts[row["slice"]]
        inverse[a:b] = np.frombuffer(row["value"], "<f4").reshape(b - a, -1)
    return Metric(terms, inverse)


def divider(known: Metric, bound: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Divides by the curvature's bound: ``bound`` on its diagonal, and between the terms of the metric as they go together there."""
    head = np.append(known.terms, len(bound) - 1)
    scale = (1 / np.sqrt(bound[head])).astype(np.float32)

    def divided(q: np.ndarray) -> np.ndarray:
        out = q / bound[:, None]
        for k in range(q.shape[1]):
            # Plain loops: the driver's matrix products may start threads that wait for each other.
            out[head, k] = scale * np.einsum("ij,j->i", known.inverse, q[head, k].astype(np.float32) * scale)
        return out

    return divided


def probabilities(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax over the last axis, and the logarithm of its denominator."""
    top = margins.max(-1, keepdims=True)
    raised = np.exp(margins - top)
    total = raised.sum(-1, keepdims=True)
    return raised / total, (top + np.log(total))[..., 0]


def losses_and_gradients(blocks: DataFrame, points: list[np.ndarray], models: list[int], n_terms: int, n_classes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums over the rows of the weighted loss and its gradient, for some models at their points; one scan."""
    m, k = len(points), n_classes
    shared = blocks.sparkSession.sparkContext.broadcast(np.concatenate(points, axis=1))

    def part(block: Block) -> tuple[np.ndarray, np.ndarray]:
        every, scales = shared.value, block.scales[:, models, None]
        margins = block.times(every[block.terms]).reshape(block.n, m, k) * scales + every[-1].reshape(m, k)
        p, log_total = probabilities(margins)
        weights = block.weights[:, models]
        own = margins[np.arange(block.n), :, block.labels]
        loss = (weights * (log_total - own)).sum(0)
        residual = (p - (block.labels[:, None] == np.arange(k))[:, None]) * weights[..., None]
        # One more column per model carries its loss in the intercept's row.
        of_terms = np.concatenate([block.turned((residual * scales).reshape(block.n, m * k)), np.zeros((len(block.terms), m))], 1)
        return of_terms, np.concatenate([residual.sum(0).ravel(), loss])

    try:
        total = summed(blocks, part, n_terms, m * k + m)
    finally:
        shared.destroy()
    return total[-1, m * k :], [total[:, i * k : (i + 1) * k] for i in range(m)]


def optimiser(
    start: np.ndarray, divided: Callable[[np.ndarray], np.ndarray], tolerance: float, max_iterations: int
) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float, float, int]]:
    """Limited-memory quasi-Newton steps on a first guess of the curvature, by which ``divided`` divides, each shortened until the loss falls enough.

    Yields points, takes the loss and gradient there, returns the last point, its
    loss, the largest entry of its gradient, and the number of steps.
    """
    x = start
    loss, gradient = yield x
    pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=MEMORY)
    steps = 0
    while steps < max_iterations and np.abs(gradient).max() > tolerance:
        direction = -towards(gradient, pairs, divided)
        slope = float((direction * gradient).sum())
        length = 1.0
        while True:
            trial = x + length * direction
            trial_loss, trial_gradient = yield trial
            # The last digits of a loss near the optimum are noise.
            if trial_loss <= loss + 1e-4 * length * slope + 1e-14 * max(1.0, abs(loss)):
                break
            fitted = -slope * length**2 / (2 * (trial_loss - loss - length * slope))
            length = min(max(fitted, 0.1 * length), 0.5 * length)
            if length < 1e-10:
                return x, loss, float(np.abs(gradient).max()), steps
        moved, turned = trial - x, trial_gradient - gradient
        curvature = float((moved * turned).sum())
        if curvature > 0:
            pairs.append((moved, turned, curvature))
        x, loss, gradient = trial, trial_loss, trial_gradient
        steps += 1
    return x, loss, float(np.abs(gradient).max()), steps


def towards(gradient: np.ndarray, pairs: deque, divided: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The inverse curvature, as the pairs show it, applied to the gradient."""
    q, shares = gradient.copy(), []
    for moved, turned, curvature in reversed(pairs):
        share = float((moved * q).sum()) / curvature
        shares.append(share)
        q -= share * turned
    q = divided(q)
    if pairs:
        _, turned, curvature = pairs[-1]
        q *= curvature / float((turned * divided(turned)).sum())
    for (moved, turned, curvature), share in zip(pairs, reversed(shares)):
        q += (share - float((turned * q).sum()) / curvature) * moved
    return q


def fit(
    blocks: DataFrame, n_terms: int, n_classes: int, c: float = 1.0, start: Sequence[np.ndarray] | None = None,
    tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS, heads: Sequence[int] = (),
) -> Fits:
    """Fits every model of ``blocks``; ``start`` gives a point for each, as ``Fits.coefficients`` has them.

    ``heads`` are those of the blocks; behind its head a model has no terms, and its coefficients are 0. A model none of whose rows has a weight keeps its start.
    """

    def sizes(block: Block) -> tuple[np.ndarray, np.ndarray]:
        return block.turned(block.weights * block.scales**2, 2), block.weights.sum(0)

    first = blocks.select("n", "weights").first()
    if first is None:
        return Fits(list(start or []), [0.0] * len(start or []), [0] * len(start or []), [0.0] * len(start or []))
    m = len(first["weights"]) // 8 // first["n"]
    began = time.monotonic()
    squares = summed(blocks, sizes, n_terms, m)
    for at, head in enumerate(heads):
        squares[head:-1, at] = 0.0
    totals = np.maximum(squares[-1], np.finfo(float).tiny)
    penalised = np.append(np.ones(n_terms), 0.0)[:, None]
    points = [np.array(p, float) for p in start] if start is not None else [np.zeros((n_terms + 1, n_classes)) for _ in range(m)]
    used = squares[-1] > 0
    dividers: list[Callable | None] = [None] * m
    if used.any():
        # One metric for all models, of their mean weight; the steps' lengths make up for the rest.
        share = np.where(used, 1 / totals, 0.0) / used.sum()
        mean = squares @ share
        # The geometric mean of the models' penalties.
        penalty = float(np.exp(-np.log(c * totals[used]).mean()))
        penalties = np.append(np.full(n_terms, penalty), 0.0)
        bound = np.maximum(mean / 4 + penalties, 1e-12)
        # With little weight the penalty outweighs most of what terms share, and a smaller table does.
        width = min(HEAD, n_terms, int(1 / (4 * penalty)), *heads)
        first = np.where(np.arange(len(mean)) < min([n_terms, *heads]), mean, -1.0)
        first[-1] = mean[-1]
        known = metric(blocks, share, first, bound, width)
        # Vocabularies differ by what the terms of each weigh.
        own = [np.maximum(squares[:, i] / totals[i] / 4 + penalties, 1e-12) for i in range(m)] if heads else [bound] * m
        dividers = [divider(known, b) for b in own]
    runs = [optimiser(points[i], dividers[i], tolerance, max_iterations) for i in range(m)]
    ended = [began] * m
    asked = {i: next(run) for i, run in enumerate(runs) if used[i]}
    done: dict[int, tuple] = {i: (points[i], 0.0, 0.0, 0) for i in range(m) if i not in asked}
    while asked:
        open_models = sorted(asked)
        losses, gradients = losses_and_gradients(blocks, [asked[i] for i in open_models], open_models, n_terms, n_classes)
        for at, i in enumerate(open_models):
            point, total = asked.pop(i), totals[i]
            loss = losses[at] / total + float((penalised * point**2).sum()) / (2 * c * total)
            gradient = gradients[at] / total + penalised * point / (c * total)
            if heads:
                gradient[heads[i] : -1] = 0.0
            try:
                asked[i] = runs[i].send((float(loss), gradient))
            except StopIteration as end:
                done[i], ended[i] = end.value, time.monotonic()
    ordered = [done[i] for i in range(m)]
    return Fits([d[0] for d in ordered], [d[2] for d in ordered], [d[3] for d in ordered], [d[1] for d in ordered], [e - began for e in ended])


def moments(blocks: DataFrame, fits: Fits, c: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each model its fitted and observed moments by term and class, from one scan; the last row is for the intercepts."""
    m, k = len(fits.coefficients), fits.coefficients[0].shape[1]
    n_terms = len(fits.coefficients[0]) - 1
    shared = blocks.sparkSession.sparkContext.broadcast(np.concatenate(fits.coefficients, axis=1))

    def part(block: Block) -> tuple[np.ndarray, np.ndarray]:
        every, scales = shared.value, block.scales[..., None]
        p, _ = probabilities(block.times(every[block.terms]).reshape(block.n, m, k) * scales + every[-1].reshape(m, k))
        own = np.broadcast_to((block.labels[:, None] == np.arange(k))[:, None], p.shape)
        both = np.concatenate([p, own], 2) * block.weights[..., None]
        return block.turned((both * scales).reshape(block.n, -1)), both.reshape(block.n, -1).sum(0)

    try:
        total = summed(blocks, part, n_terms, 2 * m * k).reshape(-1, m, 2, k)
    finally:
        shared.destroy()
    penalised = np.append(np.ones(n_terms), 0.0)[:, None]
    return [(total[:, i, 0] + penalised * point / c, total[:, i, 1]) for i, point in enumerate(fits.coefficients)]


def class_probabilities(features: str, coefficients: Sequence[np.ndarray], head: int | None = None) -> Column:
    """An array with the probability of every class under each model, one model after the other; ``head`` is one of ``blocked``."""
    m, k = len(coefficients), coefficients[0].shape[1]
    every = np.concatenate(list(coefficients), axis=1)
    x = sparse(features)

    @arrow_udf("array<double>")
    def of(places: pa.Array, amounts: pa.Array) -> pa.Array:
        starts, at = list_parts(places)
        _, values = list_parts(amounts)
        if head is not None:
            scale, kept = head_scales(starts, at, values, [head])[:, 0], at < head
            values = (values * np.repeat(scale, np.diff(starts)))[kept]
            starts, at = np.concatenate([[0], np.cumsum(kept)])[starts], at[kept]
        margins = np.empty((len(places), m * k))
        for row, (a, b) in enumerate(zip(starts, starts[1:])):
            margins[row] = values[a:b] @ every[at[a:b]] + every[-1]
        p, _ = probabilities(margins.reshape(-1, m, k))
        return pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), m * k).cast(pa.list_(pa.float64()))

    return of(x["places"], x["amounts"])


def predictions(features: str, coefficients: Sequence[np.ndarray], head: int | None = None) -> Column:
    """The most probable class under each model, as a double like the public estimators' predictions; of equal ones the first."""
    k = coefficients[0].shape[1]
    p = class_probabilities(features, coefficients, head)
    models = F.sequence(F.lit(0), F.lit(len(coefficients) - 1))

    def best(every: Column) -> Column:
        def of_model(i: Column) -> Column:
            own = F.slice(every, i * k + 1, F.lit(k))
            return (F.array_position(own, F.array_max(own)) - 1).cast("double")

        return F.transform(models, of_model)

    return F.element_at(F.transform(F.array(p), best), 1)
