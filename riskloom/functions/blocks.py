"""Matrices as binary cells: rows ``(block, v)``, and their sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCHEMA = "block long, v binary"


def block_rows(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names=["block", "v"])


def add_blocks(part: pa.Table) -> pa.Table:
    """One row with the sum of the matrices of a block."""
    total = sum(np.frombuffer(v.as_buffer()) for v in part.column("v"))
    return pa.table({"block": part.column("block").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})
