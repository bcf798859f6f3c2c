"""Many logistic fits at once: every pass over the rows serves all fits that are still going.

A fit names its split, and optionally which of several labels it reads, how many of the split's train rows, and which
genes.  Rows are packed into blocks once.  A pass multiplies each block by the weights of all fits and sums loss,
gradient and, for narrow designs, curvature per fit; the driver then moves each fit by its own step.  So the number
of scans follows the steps of the slowest fit and not the number of fits.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.blocks import SCHEMA, add_blocks, block_rows
from riskloom.operators import metrics as M
from riskloom.operators.folds import is_train_in
from riskloom.operators.models import LogisticSpec
from riskloom.runtime import cut, discard

BLOCK_BYTES = 4_000_000  # of measurements in one block
FULL_WIDTH = 128  # up to so many weights the curvature is summed too
GROUP_BYTES = 64_000_000  # of sums that the driver holds for the fits of one group
TEST, UNUSED = -2, -1


@dataclass(frozen=True)
class Fit:
    """One fit.  ``labels`` counts into the row's labels, ``size`` keeps the first train rows, ``genes`` is a mask of places."""

    spec: LogisticSpec
    split: int
    labels: int = 0
    size: int | None = None
    genes: np.ndarray | None = None


@dataclass(frozen=True)
class Design:
    """Packed rows: blocks of measurements, labels, and each row's place in the train order of every split."""

    table: DataFrame
    genes: int
    splits: tuple[int, ...]

    def drop(self) -> None:
        discard(self.table)


def pack(rows: DataFrame, split_ids: Sequence[int], labels: str | None = None, places: str | None = None) -> Design:
    """Pack ``(features, label, test_in, train_in)``.

    ``labels`` names an array of labels to use instead of ``label``; ``places`` a map from split to the row's place
    among its train rows, needed for fits with a ``size``.
    """
    splits = tuple(int(s) for s in split_ids)
    listed = F.array(*[F.lit(s) for s in splits])

    def at(s):
        side = is_train_in(s)
        mine = F.lit(0) if places is None else F.coalesce(F.try_element_at(F.col(places), s).cast("int"), F.lit(UNUSED))
        return F.when(side, mine).when(~side, F.lit(TEST)).otherwise(F.lit(UNUSED))

    body = rows.select(
        vector_to_array("features").alias("x"),
        (F.array(F.col("label").cast("double")) if labels is None else F.col(labels).cast("array<double>")).alias("y"),
        F.transform(listed, at).alias("place"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for c in ("x", "y", "place")]
            step = max(1, BLOCK_BYTES // (8 * max(1, flat[0].shape[1])))
            for i in range(0, len(batch), step):
                x, y, p = (m[i : i + step] for m in flat)
                cells = [x.astype("<f8").tobytes(), y.astype("<f8").tobytes(), p.astype("<i4").tobytes()]
                row = [pa.array([len(x)], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]]
                yield pa.RecordBatch.from_arrays(row, names=["n", "x", "y", "place"])

    first = body.select(F.size("x")).first()
    if first is None:
        raise ValueError("there are no rows to fit")
    return Design(cut(body.mapInArrow(build, "n long, x binary, y binary, place binary"), "design"), first[0], splits)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Measurements with a constant at the end, labels, and places of every block."""
    for batch in batches:
        for n, *cells in zip(batch.column("n").to_pylist(), batch.column("x"), batch.column("y"), batch.column("place")):
            x, y = (np.frombuffer(c.as_buffer(), "<f8").reshape(n, -1) for c in cells[:2])
            yield np.hstack([x, np.ones((n, 1))]), y, np.frombuffer(cells[2].as_buffer(), "<i4").reshape(n, -1)


def _rows_of(design: Design, fits: Sequence[Fit]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per fit: column of its split, of its labels, and the place before which rows train."""
    split = {s: i for i, s in enumerate(design.splits)}
    most = np.iinfo(np.int32).max
    return (np.array([split[f.split] for f in fits]), np.array([f.labels for f in fits]), np.array([most if f.size is None else f.size for f in fits]))


def _evaluate(design: Design, fits: Sequence[Fit], points: np.ndarray, full: bool) -> dict[int, np.ndarray]:
    """Summed log loss, gradient and, if ``full``, curvature of every fit at its point, in one pass."""
    split, label, size = _rows_of(design, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = points.shape[1]
        loss, gradient = np.zeros(len(points)), np.zeros(points.shape)
        curvature = np.zeros((len(points), width, width)) if full else None
        for x, y, place in _blocks(batches):
            decision = x @ points.T
            trains = (place[:, split] >= 0) & (place[:, split] < size)
            real = y[:, label]
            p = 1 / (1 + np.exp(-np.clip(decision, -700, 700)))
            loss += np.where(trains, np.logaddexp(0, decision) - real * decision, 0).sum(axis=0)
            gradient += np.where(trains, p - real, 0).T @ x
            if full:
                weight = np.where(trains, p * (1 - p), 0)
                for k in range(len(points)):
                    curvature[k] += (x * weight[:, k, None]).T @ x
        parts = [np.concatenate([[loss[k]], gradient[k], curvature[k].ravel() if full else []]) for k in range(len(points))]
        yield block_rows(dict(enumerate(parts)))

    sums = design.table.mapInArrow(run, SCHEMA).groupBy("block").applyInArrow(add_blocks, SCHEMA)
    return {r["block"]: np.frombuffer(r["v"]) for r in sums.collect()}


# -- steps ------------------------------------------------------------------------------

Steps = Generator[np.ndarray, np.ndarray, np.ndarray]  # yields a point, gets its sums, returns the weights


def _minimum_of_model(g: np.ndarray, h: np.ndarray, w: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Weights of least g.(z - w) + (z - w).h.(z - w) / 2 + l1.|z|; by coordinate descent where l1 is not 0."""
    z = w - np.linalg.lstsq(h, g, rcond=None)[0] if not l1.any() else w.copy()
    slope = g + h @ (z - w)
    for _ in range(2000 if l1.any() else 0):
        moved = 0.0
        for j in np.flatnonzero(np.diag(h) > 0):
            target = z[j] - slope[j] / h[j, j]
            new = np.sign(target) * max(abs(target) - l1[j] / h[j, j], 0.0)
            if new != z[j]:
                slope = slope + h[:, j] * (new - z[j])
                moved = max(moved, abs(new - z[j]))
                z[j] = new
        if moved <= 1e-13 * (1 + np.abs(z).max()):
            break
    return z


def newton_steps(l1: np.ndarray, l2: np.ndarray, max_iter: int, tol: float) -> Steps:
    """Newton's method, with the absolute values inside each step's model; steps are halved until the loss falls."""
    width = len(l1)
    cost = lambda loss, w: loss + (l2 * w * w).sum() / 2 + (l1 * np.abs(w)).sum()
    w = np.zeros(width)
    sums = yield w
    for _ in range(max_iter):
        loss, g, h = sums[0], sums[1 : 1 + width] + l2 * w, sums[1 + width :].reshape(width, width) + np.diag(l2)
        z = _minimum_of_model(g, h, w, l1)
        step = z - w
        if np.abs(step).max(initial=0) <= tol * (1 + np.abs(w).max(initial=0)):
            return z
        expected = g @ step + (l1 * (np.abs(z) - np.abs(w))).sum()
        part, before = 1.0, cost(loss, w)
        while True:
            at = w + part * step
            sums = yield at
            if cost(sums[0], at) <= before + 1e-4 * part * expected + 1e-13 * abs(before):
                break
            part /= 2
            if part < 1e-9:
                return w
        w = at
    return w


def quasi_newton_steps(l1: np.ndarray, l2: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Steps:
    """Limited-memory quasi-Newton; with absolute values inside the orthant that the gradient points to."""
    width = len(l1)

    def downhill(g: np.ndarray, w: np.ndarray) -> np.ndarray:
        at_zero = np.where(g + l1 < 0, g + l1, np.where(g - l1 > 0, g - l1, 0))
        return np.where(w != 0, g + l1 * np.sign(w), at_zero)

    cost = lambda loss, w: loss + (l2 * w * w).sum() / 2 + (l1 * np.abs(w)).sum()
    w, moves, turns = np.zeros(width), [], []
    sums = yield w
    g, total = sums[1 : 1 + width] + l2 * w, cost(sums[0], w)
    first = np.abs(downhill(g, w)).max(initial=0)
    for _ in range(max_iter):
        slope = downhill(g, w)
        if np.abs(slope).max(initial=0) <= tol * first:
            return w
        q, alphas = slope.copy(), []
        for s, y in zip(reversed(moves), reversed(turns)):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if moves:
            q *= (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        for s, y, a in zip(moves, turns, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        step = np.where((l1 > 0) & (q * slope <= 0), 0, -q)
        side = np.where(w != 0, np.sign(w), -np.sign(slope))
        part = 1.0 if moves else 1 / np.linalg.norm(slope)
        while True:
            at = w + part * step
            at = np.where((l1 > 0) & (at * side < 0), 0, at)
            sums = yield at
            if cost(sums[0], at) <= total + 1e-4 * slope @ (at - w):
                break
            part /= 2
            if part < 1e-14:
                return w
        new = sums[1 : 1 + width] + l2 * at
        s, y = at - w, new - g
        if s @ y > 1e-14 * (y @ y):
            moves, turns = [*moves[1 - memory :], s], [*turns[1 - memory :], y]
        fallen = total - cost(sums[0], at)
        w, g, total = at, new, cost(sums[0], at)
        if fallen <= 1e-15 * abs(total):
            return w
    return w


def solve(design: Design, fits: Sequence[Fit]) -> list[np.ndarray]:
    """Weights of every fit, the intercept last; genes outside a fit's mask weigh 0."""
    width = design.genes + 1
    full = width <= FULL_WIDTH
    at_once = max(1, GROUP_BYTES // (8 * (1 + width + (width * width if full else 0))))
    return [w for at in range(0, len(fits), at_once) for w in _solve_group(design, fits[at : at + at_once], full)]


def _solve_group(design: Design, fits: Sequence[Fit], full: bool) -> list[np.ndarray]:
    width, going, points, masks = design.genes + 1, {}, {}, []
    found: list = [None] * len(fits)
    for k, f in enumerate(fits):
        spec = f.spec.checked()
        mask = np.append(np.ones(design.genes, bool) if f.genes is None else np.asarray(f.genes, bool), spec.fit_intercept)
        pen = np.append(np.full(design.genes, 1 / spec.C), 1 / spec.C if spec.penalise_intercept else 0.0)[mask]
        none = np.zeros_like(pen)
        l1, l2 = (pen, none) if spec.penalty == "l1" else (none, pen)
        masks.append(mask)
        steps = newton_steps(l1, l2, spec.max_iter, 1e-10) if full else quasi_newton_steps(l1, l2, spec.max_iter, 1e-9)
        going[k], points[k] = steps, next(steps)
    while going:
        order = sorted(going)
        wide = np.zeros((len(order), width))
        for i, k in enumerate(order):
            wide[i, masks[k]] = points[k]
        sums = _evaluate(design, [fits[k] for k in order], wide, full)
        for i, k in enumerate(order):
            told, mask = sums[i], masks[k]
            parts = [told[:1], told[1 : 1 + width][mask]]
            if full:
                parts.append(told[1 + width :].reshape(width, width)[np.ix_(mask, mask)].ravel())
            try:
                points[k] = going[k].send(np.concatenate(parts))
            except StopIteration as end:
                found[k] = np.zeros(width)
                found[k][mask] = end.value
                del going[k]
    return found


def scores(design: Design, fits: Sequence[Fit], weights: Sequence[np.ndarray], metrics: Mapping[str, M.Metric], train: bool = False) -> list[dict]:
    """Every metric of every fit on its test rows, ``{False: {metric: value}}``, and under True on its train rows."""
    split, label, size = _rows_of(design, fits)
    points = np.stack(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, place in _blocks(batches):
            decision = x @ points.T
            for k in range(len(points)):
                mine = place[:, split[k]]
                sides = [(False, mine == TEST)] + ([(True, (mine >= 0) & (mine < size[k]))] if train else [])
                for side, hit in sides:
                    if hit.any():
                        d = decision[hit, k]
                        p = 1 / (1 + np.exp(-np.clip(d, -700, 700)))
                        key = np.full(len(d), 2 * k + side, dtype=np.int64)
                        columns = [key, y[hit, label[k]], p, d, (d > 0).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fit", "label", "p1", "decision", "prediction"])

    scored = design.table.mapInArrow(run, "fit long, label double, p1 double, decision double, prediction int")
    found = M.model_scores(scored, metrics, "fit")
    nothing = dict.fromkeys(metrics)
    return [{side: found.get(2 * k + side, nothing) for side in ((False, True) if train else (False,))} for k in range(len(fits))]
