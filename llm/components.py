"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``vertex`` and ``label`` (least vertex of its component) for every vertex of (a, b).

    Each round points vertices at the least neighbour; a minimum per vertex is summed up before its shuffle
    and joined back, so a vertex with a third of all edges is never one group in one task.  Every round is
    written, and the rounds end when one changes nothing.
    """
    edges = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(edges)
    while True:
        # large star: larger neighbours of every vertex move to its least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("_m", "a").alias("_m"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = written(moved.distinct(), "large_star")
        # small star: a vertex and its smaller neighbours move to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), "_m")
        joined = edges.join(least, F.col("a") == F.col("_a"))
        moved = joined.select(F.explode(F.array(F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e"))
        edges = written(moved.select("e.a", "e.b").where("a != b").distinct(), "small_star")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("label")).unionByName(roots)
