"""Principal components for any number of genes and samples.

The centred measurements are cut into dense tiles of some genes and some samples, written once and bucketed by
tile.  A round multiplies a factor (a few columns per gene) by the tiles and back: one row of the factor goes to
each tile of its genes, partial products are summed up inside the tasks, and the tiles stay where they are.

The search space grows by the residuals of the present components (block Davidson, Rayleigh-Ritz on the whole
space).  The driver sees inner products of the columns alone.  Rounds end on the residual of every single
component: residual / gap to the next eigenvalue bounds the error of its loadings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.functions.blocks import SCHEMA, add_blocks, block_rows
from riskloom.functions.joins import join_by_key
from riskloom.functions.rowindex import with_row_index
from riskloom.runtime import cut, discard, scratch_path

GENES_PER_TILE, SAMPLES_PER_TILE = 512, 2048  # 8 MB a tile
TILES_PER_BUCKET = 4
MOST_COLUMNS = 256  # of the search space; beyond it the best components start a new one
SUM_BYTES = 64_000_000  # partial products that a task holds


@dataclass(frozen=True)
class GeneComponents:
    """``loadings(component, gene_id, loading)``, ``centre(gene_id, mean, n)``, eigenvalues and error bounds per component."""

    loadings: DataFrame
    centre: DataFrame
    eigenvalues: tuple[float, ...]
    errors: tuple[float, ...]

    def transform(self, expr: DataFrame) -> DataFrame:
        """``(sample_id, features ARRAY)``: component scores of the samples of a long table ``(sample_id, gene_id, value)``.

        Genes that the fit has not seen count for nothing, and missing ones as their mean.
        """
        k = len(self.eigenvalues)
        wide = self.loadings.groupBy("gene_id").agg(*[F.max(F.when(F.col("component") == c, F.col("loading"))).alias(f"_l{c}") for c in range(k)])
        sizes = expr.groupBy("gene_id").agg(F.count("*").alias("_n"))
        side = wide.join(self.centre.select("gene_id", F.col("mean").alias("_mean")), "gene_id").join(sizes, "gene_id")
        cells = join_by_key(expr.select("sample_id", "gene_id", "value"), side, ["gene_id"], "_n")
        sums = cells.groupBy("sample_id").agg(*[F.sum((F.col("value") - F.col("_mean")) * F.col(f"_l{c}")).alias(f"_s{c}") for c in range(k)])
        return sums.select("sample_id", F.array(*[f"_s{c}" for c in range(k)]).alias("features"))


class _Tiles:
    """The tiles of a long table, and products with them."""

    def __init__(self, expr: DataFrame):
        self.spark = expr.sparkSession
        means = expr.groupBy("gene_id").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
        self.genes = cut(with_row_index(means, ["gene_id"], name="place"), "genes")
        samples = expr.groupBy("sample_id").agg(F.count("*").alias("n"))
        samples = cut(with_row_index(samples, ["sample_id"], name="row"), "samples")
        self.n_genes, self.n_samples = self.genes.count(), samples.count()
        self.gene_blocks, self.sample_blocks = -(-self.n_genes // GENES_PER_TILE), -(-self.n_samples // SAMPLES_PER_TILE)
        cells = join_by_key(expr.where("value IS NOT NULL").select("sample_id", "gene_id", "value"), self.genes, ["gene_id"], "n")
        cells = cells.select("sample_id", "place", (F.col("value") - F.col("mean")).alias("value"))
        cells = join_by_key(cells, samples, ["sample_id"], "n", spread="place").select("place", "row", "value")
        tile = F.floor(F.col("place") / GENES_PER_TILE) * self.sample_blocks + F.floor(F.col("row") / SAMPLES_PER_TILE)
        buckets = max(1, min(-(-self.gene_blocks * self.sample_blocks // TILES_PER_BUCKET), 100_000))
        dense = cells.withColumn("tile", tile.cast("long")).repartition(buckets, "tile").groupBy("tile").applyInArrow(self._dense(), "tile long, cells binary")
        self.name = f"riskloom_{uuid.uuid4().hex}"
        dense.write.bucketBy(buckets, "tile").sortBy("tile").option("path", scratch_path(self.spark, "tiles")).saveAsTable(self.name)
        self.table = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")

    def _dense(self) -> Callable:
        n_genes, n_samples, across = self.n_genes, self.n_samples, self.sample_blocks

        def build(part: pa.Table) -> pa.Table:
            tile = part.column("tile")[0].as_py()
            width = min(GENES_PER_TILE, n_genes - tile // across * GENES_PER_TILE)
            height = min(SAMPLES_PER_TILE, n_samples - tile % across * SAMPLES_PER_TILE)
            out = np.zeros((height, width))
            out[part.column("row").to_numpy() % SAMPLES_PER_TILE, part.column("place").to_numpy() % GENES_PER_TILE] = part.column("value").to_numpy()
            return pa.table({"tile": pa.array([tile]), "cells": pa.array([out.tobytes()], pa.binary())})

        return build

    def times(self, factor: DataFrame, columns: int) -> DataFrame:
        """The product of the tiles and back, for a factor ``(block, v)`` with ``columns`` columns per gene."""
        scores = cut(self._product(factor, columns, True), "scores")
        return self._product(scores, columns, False)

    def _product(self, factor: DataFrame, columns: int, forward: bool) -> DataFrame:
        across, n_genes = self.sample_blocks, self.n_genes
        of = F.sequence(F.lit(0).cast("long"), F.lit((self.sample_blocks if forward else self.gene_blocks) - 1).cast("long"))
        tiles = F.transform(of, lambda o: F.col("block") * across + o if forward else o * across + F.col("block"))
        sent = factor.select(F.explode(tiles).alias("_tile"), "v")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, held = {}, 0
            for batch in batches:
                for tile, cells, v in zip(batch.column("tile").to_pylist(), batch.column("cells"), batch.column("v")):
                    width = min(GENES_PER_TILE, n_genes - tile // across * GENES_PER_TILE)
                    x = np.frombuffer(cells.as_buffer()).reshape(-1, width)
                    f = np.frombuffer(v.as_buffer()).reshape(-1, columns)
                    block, part = (tile % across, x @ f) if forward else (tile // across, x.T @ f)
                    if block in sums:
                        sums[block] += part
                    else:
                        sums[block] = part
                        held += part.nbytes
                if held > SUM_BYTES:
                    yield block_rows(sums)
                    sums, held = {}, 0
            if sums:
                yield block_rows(sums)

        partial = self.table.join(sent, F.col("tile") == F.col("_tile")).select("tile", "cells", "v").mapInArrow(multiply, SCHEMA)
        return partial.groupBy("block").applyInArrow(add_blocks, SCHEMA)


def _by_block(table: DataFrame, change: Callable[..., list[np.ndarray]], names: list[str]) -> DataFrame:
    """``change(block, *matrices as flat arrays)`` of every row gives its new matrices ``names``."""
    schema = "block long, " + ", ".join(f"{n} binary" for n in names)
    given = [c for c in table.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                flat = [np.frombuffer(batch.column(c)[i].as_buffer()) if batch.column(c)[i].is_valid else None for c in given]
                out = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in change(block, *flat)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *out], names=["block", *names])

    return table.mapInArrow(run, schema)


def _total(table: DataFrame) -> np.ndarray:
    """Sum of the matrices ``v`` of all rows; they are small, and summed per task before they meet."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.frombuffer(v.as_buffer()) for batch in batches for v in batch.column("v")]
        if sums:
            yield block_rows({0: sum(sums)})

    whole = table.mapInArrow(inside, SCHEMA).groupBy("block").applyInArrow(add_blocks, SCHEMA)
    return np.frombuffer(whole.first()["v"])


def _ritz(overlap: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and coefficients, from the inner products of columns with each other and their images."""
    sizes, turn = np.linalg.eigh((overlap + overlap.T) / 2)
    used = sizes > 1e-12 * sizes.max()
    white = turn[:, used] / np.sqrt(sizes[used])
    values, inner = np.linalg.eigh(white.T @ ((image + image.T) / 2) @ white)
    return values[::-1], (white @ inner)[:, ::-1]


def fit_gene_components(expr: DataFrame, k: int, extra: int = 8, max_rounds: int = 60, tol: float = 1e-8) -> GeneComponents:
    """The first ``k`` components of ``expr(sample_id, gene_id, value)``, one value per sample and gene; null counts as the mean.

    Every loading vector is within about ``tol`` of the true one (its sign is free), else an error is raised:
    after ``max_rounds`` rounds, or when components have the same variance and so no direction of their own.
    Rounds needed follow the gaps between the eigenvalues, not the number of genes or samples.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    tiles = _Tiles(expr)
    try:
        return _davidson(tiles, k, extra, max_rounds, tol)
    finally:
        tiles.drop()


def _davidson(tiles: _Tiles, k: int, extra: int, max_rounds: int, tol: float) -> GeneComponents:
    if tiles.n_genes < k:
        raise ValueError(f"there are only {tiles.n_genes} genes")
    spark, n_genes, q = tiles.spark, tiles.n_genes, min(k + extra, tiles.n_genes)
    width = lambda block: min(GENES_PER_TILE, n_genes - block * GENES_PER_TILE)
    start = spark.range(tiles.gene_blocks).select(F.col("id").alias("block"))
    fresh = cut(_by_block(start, lambda block: [np.random.default_rng(block).standard_normal((width(block), q))], ["v"]), "directions")
    space, m, overlap, image, errors = None, 0, np.zeros((0, 0)), np.zeros((0, 0)), None
    for turn in range(max_rounds):
        new = q
        product = tiles.times(fresh, new).withColumnsRenamed({"block": "_block", "v": "z"})
        joined = fresh.join(product, F.col("block") == F.col("_block"), "left").drop("_block")
        if space is not None:
            joined = joined.join(space.withColumnsRenamed({"block": "_block", "b": "_b", "a": "_a"}), F.col("block") == F.col("_block")).drop("_block")

        def longer(block, v, z, b=None, a=None, m=m, new=new):
            rows = width(block)
            z = np.zeros(rows * new) if z is None else z  # genes without any value
            old = [np.zeros((rows, 0)) if x is None else x.reshape(rows, m) for x in (b, a)]
            return [np.hstack([old[0], v.reshape(rows, new)]), np.hstack([old[1], z.reshape(rows, new)])]

        grown = cut(_by_block(joined, longer, ["b", "a"]), "space")
        if space is not None:
            discard(space)
        discard(fresh)
        space, m = grown, m + new

        def products(block, b, a, m=m, new=new):
            b, a = b.reshape(-1, m), a.reshape(-1, m)
            return [np.hstack([b.T @ b[:, m - new :], b.T @ a[:, m - new :]])]

        added = _total(_by_block(space, products, ["v"])).reshape(m, 2 * new)
        overlap, image = (_bordered(old, added[:, at : at + new]) for old, at in ((overlap, 0), (image, new)))
        values, coefficients = _ritz(overlap, image)
        if len(values) < k:
            raise ValueError(f"the measurements have only {len(values)} components")
        shown = min(k + extra, len(values))
        theta, w = values[:shown], coefficients[:, :shown]

        def residuals(block, b, a, m=m, w=w, theta=theta):
            return [a.reshape(-1, m) @ w - (b.reshape(-1, m) @ w) * theta]

        left = cut(_by_block(space, residuals, ["v"]), "residuals")
        norms = np.sqrt(_total(_by_block(left, lambda block, v, shown=shown: [(v.reshape(-1, shown) ** 2).sum(axis=0)], ["v"])))
        gaps = np.array([np.delete(np.abs(values - values[j]), j).min(initial=np.inf) for j in range(k)])
        errors = norms[:k] / np.maximum(gaps, 1e-300)
        exact = norms[:k] <= 1e-14 * values[0]  # as far as numbers go
        useful = norms > 1e-13 * max(values[0], 1e-300)
        determined = ((errors <= tol) | (exact & (gaps > 1e-8 * values[0]))).all()
        if determined and (turn or not useful.any()):
            return _found(tiles, space, m, w[:, :k], values[:k], errors)
        if not useful.any():
            break
        q = int(useful.sum())
        scale = useful.nonzero()[0], norms[useful]
        fresh = cut(_by_block(left, lambda block, v, scale=scale, shown=shown: [v.reshape(-1, shown)[:, scale[0]] / scale[1]], ["v"]), "directions")
        discard(left)
        if m + q > max(MOST_COLUMNS, 4 * (k + extra)):
            kept = coefficients[:, : 2 * (k + extra)]
            again = cut(_by_block(space, lambda block, b, a, m=m, kept=kept: [b.reshape(-1, m) @ kept, a.reshape(-1, m) @ kept], ["b", "a"]), "space")
            discard(space)
            space, m = again, kept.shape[1]
            overlap, image = kept.T @ overlap @ kept, kept.T @ image @ kept
    raise RuntimeError(f"components are not determined after {turn + 1} rounds; error bounds {np.array(errors).tolist()}")


def _bordered(old: np.ndarray, added: np.ndarray) -> np.ndarray:
    """A symmetric matrix with its last columns ``added``."""
    m, new = added.shape
    out = np.zeros((m, m))
    out[: m - new, : m - new] = old
    out[:, m - new :] = added
    out[m - new :, : m - new] = added[: m - new].T
    return out


def _found(tiles: _Tiles, space: DataFrame, m: int, w: np.ndarray, values: np.ndarray, errors: np.ndarray) -> GeneComponents:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, b in zip(batch.column("block").to_pylist(), batch.column("b")):
                v = np.frombuffer(b.as_buffer()).reshape(-1, m) @ w
                place, component = (x.ravel() for x in np.indices(v.shape))
                columns = [pa.array(component.astype(np.int32)), pa.array(place + block * GENES_PER_TILE), pa.array(v.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["component", "_place", "loading"])

    long = space.select("block", "b").mapInArrow(rows, "component int, _place long, loading double")
    named = long.join(tiles.genes, F.col("_place") == F.col("place"))
    loadings = cut(named.select("component", "gene_id", "loading"), "loadings")
    discard(space)
    return GeneComponents(loadings, tiles.genes.select("gene_id", "mean", "n"), tuple(values.tolist()), tuple(errors.tolist()))
