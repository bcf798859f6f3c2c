"""Merkle manifest of a dataset with incremental witnesses (operator 11).

Rows are leaves, numbered inside their group.  Tasks append aligned blocks of leaves: completed subtrees of
equal height merge at once, every leaf keeps the partial witness of its open subtree, and each sibling that
completes later extends it.  The roots of the blocks are further leaves of the same kind, appended in blocks
again until one root is left.  A leaf's witness is that of its block followed by that of its block's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import written
from riskloom.functions.rowindex import with_row_index

#: Height of a block; a task holds 2**HEIGHT leaves at once.
HEIGHT = 12


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Frontier:
    """Open subtrees of a block, left to right and ever smaller, and the witnesses of its leaves so far.

    A witness step is ``R`` or ``L`` and the digest of the sibling on that side, or ``.`` where a node has none.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int]] = []  # height, digest, first leaf
        self.witnesses: list[list[str]] = []

    def append(self, leaf: str) -> None:
        self.open.append((0, leaf, len(self.witnesses)))
        self.witnesses.append([])
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._merge()

    def _merge(self) -> None:
        (height, left, first), (_, right, second) = self.open[-2:]
        for w in self.witnesses[first:second]:
            w.append("R" + right)
        for w in self.witnesses[second:]:
            w.append("L" + left)
        self.open[-2:] = [(height + 1, digest(left, right), first)]

    def close(self, height: int) -> str:
        """The root at ``height``: the last subtree rises alone until it meets the one before it."""
        while self.open[-1][0] < height:
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._merge()
                continue
            low, node, first = self.open[-1]
            for w in self.witnesses[first:]:
                w.append(".")
            self.open[-1] = (low + 1, digest(node), first)
        return self.open[-1][1]


def _append(height: int) -> Callable:
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        total = part.column("total")[0].as_py()
        tree = Frontier()
        for leaf in part.column("node").to_pylist():
            tree.append(leaf)
        root = tree.close(min(height, (total - 1).bit_length()))
        steps = pa.array(tree.witnesses, pa.list_(pa.string()))
        return part.append_column("steps", steps).append_column("top", pa.array([root] * len(part), pa.string())).drop_columns(["total", "node"])

    return run


def _grown(nodes: DataFrame, payload: Sequence[str], height: int) -> DataFrame:
    """``grp``, ``payload``, ``steps`` and ``root`` of every node (``grp``, ``at``, ``total``, ``node``, ``payload``).

    Payload columns are strings or longs.  A block has at most 2**height rows, whatever its group holds.
    """
    types = dict(nodes.dtypes)
    held = nodes.select("grp", F.shiftright("at", height).alias("block"), "at", "total", "node", *payload)
    schema = ", ".join(["grp string", "block long", "at long", *[f"{c} {types[c]}" for c in payload], "steps array<string>", "top string"])
    blocks = written(held.groupBy("grp", "block").applyInArrow(_append(height), schema), "blocks")
    most = nodes.agg(F.max("total")).first()[0]
    if most is None or most <= 1 << height:
        return blocks.select("grp", *payload, "steps", F.col("top").alias("root"))
    heads = blocks.where(F.expr(f"at % {1 << height} = 0")).select("grp", "block", F.col("top").alias("node"))
    totals = nodes.where("at = 0").select(F.col("grp").alias("_grp"), F.ceil(F.col("total") / (1 << height)).cast("long").alias("total"))
    heads = heads.join(totals, F.col("grp") == F.col("_grp")).select("grp", F.col("block").alias("at"), "total", "node", F.col("block").alias("below"))
    upper = _grown(heads, ["below"], height).select(F.col("grp").alias("_grp"), F.col("below").alias("_block"), F.col("steps").alias("_steps"), "root")
    joined = blocks.join(upper, (F.col("grp") == F.col("_grp")) & (F.col("block") == F.col("_block")))
    return joined.select("grp", *payload, F.concat("steps", "_steps").alias("steps"), "root")


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of the columns: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its witness give."""

    def step(node: Column, s: Column) -> Column:
        side, sibling = F.left(s, F.lit(1)), F.substring(s, 2, 64)
        return F.sha2(F.when(side == "R", F.concat(node, sibling)).when(side == "L", F.concat(sibling, node)).otherwise(node), 256)

    return F.aggregate(steps, leaf, step)


def proof(steps: Column) -> Column:
    """Digest of the siblings of a witness, in its order."""
    return F.sha2(F.array_join(F.transform(F.filter(steps, lambda s: s != "."), lambda s: F.substring(s, 2, 64)), ""), 256)


def manifest(leaves: DataFrame, group: str, order: Sequence[str], leaf: str, keep: Sequence[str] = (), height: int = HEIGHT) -> DataFrame:
    """One row per row of ``leaves``: leaf, ``keep``, subroot, root and steps (the witness from leaf to root).

    Leaves of one ``group`` ascend by ``order``, null first, equal ones by digest; groups ascend by code point,
    null first.  Rows that are equal in all of this are interchangeable, so the result is the same on each
    run.  An empty table gives no rows.
    """
    # null becomes '' and a value follows '+': the order of the groups stays, and no group is null
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    kept = F.struct(F.col(f"`{leaf}`").alias("leaf"), *[F.col(f"`{c}`") for c in keep if c != "leaf"])  # their names cannot clash with those here
    sorted_by = {f"by{i}": F.col(f"`{c}`") for i, c in enumerate(order)}
    rows = leaves.select(name.alias("grp"), F.col(f"`{leaf}`").alias("node"), kept.alias("kept"), *[c.alias(n) for n, c in sorted_by.items()])
    inner = _grown(with_row_index(rows, [*sorted_by, "node"], ["grp"], name="at", count="total"), ["kept"], height)
    inner = inner.select("grp", "kept", F.col("root").alias("subroot"), "steps")
    tops = inner.groupBy("grp").agg(F.min("subroot").alias("node")).select(F.lit("").alias("all"), F.col("grp").alias("of"), "node")
    listed = with_row_index(tops, ["of"], ["all"], name="at", count="total").withColumnRenamed("all", "grp")
    outer = _grown(listed, ["of"], height).select("of", F.col("steps").alias("_steps"), "root")
    joined = inner.join(outer, F.col("grp") == F.col("of"))
    return joined.select("kept.*", "subroot", "root", F.concat("steps", "_steps").alias("steps"))


def document_manifest(docs: DataFrame, tampered_every: int = 7, height: int = HEIGHT) -> DataFrame:
    """One row per row of documents: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves cover doc_id, source, lang, n_chars and text, grouped by lang.  Where ``tampered_every`` divides
    the CRC-32 of the decimal doc_id, n_chars grows by 1 before the leaf is folded with its untampered
    witness; null ids and null n_chars stay as they are.  Null ids come first, of equal ids the least leaf.
    Other columns are not read.
    """
    ident, chars, longer = (F.col("doc_id").cast("long"), F.col("n_chars").cast("long"), (F.col("n_chars").cast("decimal(20,0)") + 1))
    of = lambda n: leaf_of([ident, F.col("source"), F.col("lang"), n, F.col("text")])
    hit = F.coalesce(F.crc32(ident.cast("string")) % tampered_every == 0, F.lit(False)) & chars.isNotNull()
    leaves = docs.select(ident.alias("doc_id"), "lang", of(chars).alias("leaf"), F.when(hit, of(longer)).alias("changed"))
    found = manifest(leaves, "lang", ["doc_id"], "leaf", ["doc_id", "changed"], height)
    back = folded(F.coalesce("changed", "leaf"), F.col("steps"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
