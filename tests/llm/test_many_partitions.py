"""Rows of exact dedup are told apart whatever the number of the partition they come from."""

import hashlib

import numpy as np
import pyarrow as pa

from llm.exact_dedup import _judge


def test_rows_of_late_partitions():
    texts = [b"a", b"b", b"a"]
    shas = [hashlib.sha256(t).digest() for t in texts]
    keys = np.array([int.from_bytes(s[:8], "little") for s in shas], dtype="<u8").tobytes()
    rows = []
    for partition in (0, 2047, 2048, 1_000_000):
        unit = [{"unit": (partition << 24) + 1, "keys": keys, "answers": None, "doc_ids": [1, 2, 3], "shas": b"".join(shas)}]
        rows += [r for b in _judge(24)(iter([pa.RecordBatch.from_pylist(unit)])) for r in b.to_pylist()]
    assert [r["suspect"] for r in rows] == [True, False, True] * 4
    assert len({tuple(v for c, v in r.items() if c not in ("doc_id", "sha", "suspect")) for r in rows}) == 12
