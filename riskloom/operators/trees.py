"""Random forests and boosted trees from histograms.

Measurements are binned once.  All nodes of a level, of all trees of a forest, are split from one pass: each task adds up
gradient and curvature per (node, gene, bin) of its rows, sums meet per stretch of genes, and only the best split of each
node reaches the driver.  A forest is the same with label and count in place of gradient and curvature, so its gain is
that of the Gini index; trees grow until nothing can be split, without a bound on their depth.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskloom.functions.rowindex import with_row_index
from riskloom.operators.models import Spec
from riskloom.runtime import cut, discard

GENES_PER_SUM = 256  # genes whose histograms meet in one task
HISTOGRAM_BYTES = 128_000_000  # of all histograms that a task adds up; more nodes take another pass
BLOCK_BYTES = 4_000_000


@dataclass
class Tree:
    """Nodes as lists; a leaf has gene -1.  Rows with a value up to ``threshold`` (bin up to ``bin``) go left."""

    gene: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, gene: int, at: int, threshold: float, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        self.gene[node], self.bin[node], self.threshold[node], self.gain[node] = gene, at, threshold, gain
        self.left[node], self.right[node] = len(self.gene), len(self.gene) + 1
        for v in values:
            for column, start in ((self.gene, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, v), (self.gain, 0.0)):
                column.append(start)
        return self.left[node], self.right[node]

    def leaf_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """Node in which every row ends."""
        gene, cutoff = np.array(self.gene), np.array(self.bin if binned else self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[gene[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(x[rows, gene[at]] <= cutoff[at], left[at], right[at])
        return node


@dataclass(frozen=True)
class _Binned:
    table: DataFrame  # n, bins, y, draws (hash of the sample)
    edges: list[np.ndarray]

    @property
    def most(self) -> int:
        return max(len(e) for e in self.edges)


def bin_edges(rows: DataFrame, max_bins: int) -> list[np.ndarray]:
    """Upper ends of at most ``max_bins`` bins per gene: all its values if there are no more, else values of even rank.

    One list per gene on the driver, ``max_bins`` numbers each.
    """
    cells = rows.select(F.posexplode(vector_to_array("features")).alias("gene", "value")).distinct()
    placed = with_row_index(cells, ["value"], ["gene"], name="ix", count="n")
    at = F.floor(F.col("ix") * max_bins / F.greatest("n", F.lit(max_bins)))
    ends = placed.groupBy("gene", at.alias("bin")).agg(F.max("value").alias("edge"))
    listed = ends.groupBy("gene").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return [np.array(r["edges"]) for r in sorted(listed.collect(), key=lambda r: r["gene"])]


def _binned(rows: DataFrame, max_bins: int) -> _Binned:
    if not 2 <= max_bins <= 65_535:
        raise ValueError("max_bins lies within 2 and 65535")
    edges = bin_edges(rows, max_bins)
    if not edges:
        raise ValueError("there are no rows to fit")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            step = max(1, BLOCK_BYTES // (8 * x.shape[1])) if len(batch) else 1
            for i in range(0, len(batch), step):
                part = x[i : i + step]
                bins = np.stack([np.searchsorted(e, part[:, g]) for g, e in enumerate(edges)], axis=1).astype("<u2")
                cells = [bins.tobytes(), *[batch.column(c).slice(i, step).to_numpy(zero_copy_only=False).tobytes() for c in ("y", "draw")]]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names=["n", "bins", "y", "draws"])

    body = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.xxhash64("sample_id").alias("draw"))
    return _Binned(cut(body.mapInArrow(build, "n long, bins binary, y binary, draws binary"), "binned"), edges)


def bootstrap_counts(draws: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each sample is drawn for a tree: Poisson numbers with mean 1, fixed by sample, seed and tree."""
    h = draws.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xBF58476D1CE4E5B9) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8]))
    return np.searchsorted(steps, (h >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


@dataclass(frozen=True)
class _Rules:
    alpha: float = 0.0
    reg_lambda: float = 0.0
    gamma: float = 0.0
    least_curvature: float = 0.0

    def pull(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0)

    def score(self, g, h):
        return self.pull(g) ** 2 / np.maximum(h + self.reg_lambda, 1e-300)

    def weight(self, g: float, h: float) -> float:
        return float(-self.pull(g) / (h + self.reg_lambda)) if h + self.reg_lambda > 0 else 0.0


def _best_splits(design: _Binned, slots: Sequence[tuple[int, int]], trees: dict[int, Tree], statistics, rules: _Rules, allowed) -> dict[int, tuple]:
    """Per slot (tree, node) the best split: gain, gene, bin, sums on the left and in the node.  One pass.

    ``statistics(bins, y, draws, tree)`` gives gradient and curvature of each row, ``allowed(tree, node)`` the genes.
    """
    genes, most = len(design.edges), design.most
    stretches = [(a, min(a + GENES_PER_SUM, genes)) for a in range(0, genes, GENES_PER_SUM)]
    of_tree: dict[int, dict[int, int]] = {}
    for k, (t, node) in enumerate(slots):
        of_tree.setdefault(t, {})[node] = k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros((2, len(slots) * (b - a) * most)) for s, (a, b) in enumerate(stretches)}
        for batch in batches:
            for n, *cells in zip(batch.column("n").to_pylist(), batch.column("bins"), batch.column("y"), batch.column("draws")):
                bins, y, draws = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(cells, ("<u2", "<f8", "<i8")))
                bins = bins.reshape(n, genes).astype(np.int64)
                for t, nodes in of_tree.items():
                    slot_of = np.full(len(trees[t].gene), -1)
                    slot_of[list(nodes)] = list(nodes.values())
                    slot = slot_of[trees[t].leaf_of(bins, True)]
                    g, h = statistics(bins, y, draws, t)
                    here = (slot >= 0) & (h > 0)
                    if not here.any():
                        continue
                    for s, (a, b) in enumerate(stretches):
                        place = ((slot[here, None] * (b - a) + np.arange(b - a)) * most + bins[here, a:b]).ravel()
                        for i, v in enumerate((g[here], h[here])):
                            sums[s][i] += np.bincount(place, weights=np.repeat(v, b - a), minlength=sums[s].shape[1])
        for s, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["stretch", "v"])

    def best(part: pa.Table) -> pa.Table:
        s = part.column("stretch")[0].as_py()
        a, b = stretches[s]
        total = sum(np.frombuffer(v.as_buffer()) for v in part.column("v")).reshape(2, len(slots), b - a, most)
        left = np.cumsum(total, axis=3)
        whole = left[:, :, :, -1:]
        (gl, hl), (gw, hw) = left, whole
        gain = (rules.score(gl, hl) + rules.score(gw - gl, hw - hl) - rules.score(gw, hw)) / 2 - rules.gamma
        fits = (hl > 0) & (hw - hl > 1e-9) & (hl >= rules.least_curvature) & (hw - hl >= rules.least_curvature)
        gain = np.where(fits, gain, -np.inf)
        for k, (t, node) in enumerate(slots):
            chosen = allowed(t, node)
            if chosen is not None:
                gain[k, ~np.isin(np.arange(a, b), chosen)] = -np.inf
        flat = gain.reshape(len(slots), -1)
        at = flat.argmax(axis=1)
        k, (gene, split) = np.arange(len(slots)), np.divmod(at, most)
        numbers = [flat[k, at], gl[k, gene, split], hl[k, gene, split], gw[k, 0, 0], hw[k, 0, 0]]
        columns = [pa.array(k), pa.array(gene + a), pa.array(split), *[pa.array(x.astype(float)) for x in numbers]]
        return pa.table(dict(zip(("slot", "gene", "bin", "gain", "gl", "hl", "gw", "hw"), columns)))

    schema = "slot long, gene long, bin long, gain double, gl double, hl double, gw double, hw double"
    found = design.table.mapInArrow(count, "stretch long, v binary").groupBy("stretch").applyInArrow(best, schema)
    best_of = found.groupBy("slot").agg(F.max(F.struct("gain", (-F.col("gene")).alias("gene"), (-F.col("bin")).alias("bin"), "gl", "hl", "gw", "hw")).alias("b"))
    return {r["slot"]: (r["b"]["gain"], -r["b"]["gene"], -r["b"]["bin"], *tuple(r["b"])[3:]) for r in best_of.collect()}


def _grow(design: _Binned, n_trees: int, max_depth: int | None, statistics, rules: _Rules, scale: float, allowed=lambda t, node: None) -> list[Tree]:
    """Grow trees level by level, all at once."""
    trees = {t: Tree() for t in range(n_trees)}
    level, depth = [(t, 0) for t in range(n_trees)], 0
    at_once = max(1, HISTOGRAM_BYTES // (16 * len(design.edges) * design.most))
    while level and (max_depth is None or depth <= max_depth):
        following = []
        for at in range(0, len(level), at_once):
            slots = level[at : at + at_once]
            if max_depth == depth and depth:  # leaves have their values from the split above
                continue
            for k, (gain, gene, split, gl, hl, gw, hw) in _best_splits(design, slots, trees, statistics, rules, allowed).items():
                t, node = slots[k]
                trees[t].value[node] = scale * rules.weight(gw, hw)
                if gain > 1e-12 and max_depth != depth:
                    values = scale * rules.weight(gl, hl), scale * rules.weight(gw - gl, hw - hl)
                    following += [(t, child) for child in trees[t].split(node, gene, split, float(design.edges[gene][split]), gain, values)]
        level, depth = following, depth + 1
    return list(trees.values())


@dataclass(frozen=True)
class FittedTrees:
    """Trees as a classifier: the mean of their values is the probability, or their sum the decision value."""

    trees: list[Tree]
    genes: int
    averaged: bool

    @property
    def weights(self) -> np.ndarray:
        """Share of each gene in all gains."""
        out = np.zeros(self.genes)
        for tree in self.trees:
            for gene, gain in zip(tree.gene, tree.gain):
                if gene >= 0:
                    out[gene] += gain
        return out / out.sum() if out.any() else out

    def transform(self, rows: DataFrame) -> DataFrame:
        trees = self.trees

        @F.pandas_udf("double")
        def total(features: pd.Series) -> pd.Series:
            x = np.stack(features) if len(features) else np.zeros((0, 1))
            return pd.Series(sum((np.array(t.value)[t.leaf_of(x, False)] for t in trees), np.zeros(len(x))))

        summed = rows.withColumn("decision", total(vector_to_array("features")))
        p1 = F.col("decision") / len(trees) if self.averaged else 1 / (1 + F.exp(-F.col("decision")))
        scored = summed.withColumn("p1", p1)
        return scored.select(*rows.columns, "p1", "decision", (F.col("p1") > 0.5).cast("int").alias("prediction"))


@dataclass(frozen=True)
class ForestSpec(Spec):
    """Random forest; ``max_features`` is 'sqrt', 'log2', 'auto' (sqrt), 'all' or a share of the genes, drawn per node.

    Without ``max_depth`` trees grow until their leaves are pure or cannot be split.
    """

    max_depth: int | None = None
    n_trees: int = 20
    max_features: str | float = "auto"
    bootstrap: bool = True
    max_bins: int = 64
    seed: int = 0

    def genes_per_node(self, genes: int) -> int:
        named = {"auto": genes**0.5, "sqrt": genes**0.5, "log2": log2(max(genes, 2)), "all": genes}
        wanted = named[self.max_features] if self.max_features in named else float(self.max_features) * genes
        return min(genes, max(1, int(wanted)))

    def fit(self, rows: DataFrame, n: int | None = None) -> FittedTrees:
        design = _binned(rows, self.max_bins)
        genes, seed, drawn = len(design.edges), self.seed, self.bootstrap
        chosen = self.genes_per_node(genes)

        def statistics(bins, y, draws, tree):
            times = bootstrap_counts(draws, seed, tree) if drawn else np.ones(len(y))
            return -y * times, times

        def allowed(tree, node):
            return None if chosen == genes else np.random.default_rng([seed, tree, node]).choice(genes, chosen, replace=False)

        trees = _grow(design, self.n_trees, self.max_depth, statistics, _Rules(), 1.0, allowed)
        discard(design.table)
        return FittedTrees(trees, genes, True)


@dataclass(frozen=True)
class BoostedSpec(Spec):
    """Gradient-boosted trees on the log loss, with penalties on leaf weights: ``alpha`` on their size, ``reg_lambda`` on
    their square, ``gamma`` per leaf.  A child needs ``min_child_weight`` of curvature."""

    max_depth: int = 3
    learning_rate: float = 0.1
    n_rounds: int = 100
    alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_bins: int = 64

    def fit(self, rows: DataFrame, n: int | None = None) -> FittedTrees:
        design = _binned(rows, self.max_bins)
        rules = _Rules(self.alpha, self.reg_lambda, self.gamma, self.min_child_weight)
        trees: list[Tree] = []
        for _ in range(self.n_rounds):
            before = list(trees)

            def statistics(bins, y, draws, tree, before=before):
                margin = sum((np.array(t.value)[t.leaf_of(bins, True)] for t in before), np.zeros(len(y)))
                p = 1 / (1 + np.exp(-margin))
                return p - y, p * (1 - p)

            trees += _grow(design, 1, self.max_depth, statistics, rules, self.learning_rate)
        discard(design.table)
        return FittedTrees(trees, len(design.edges), False)
