"""Owners of the key exchange get about equal shares of what suffix dedup sends."""

import numpy as np
import pyarrow as pa

from llm.exchange import owner_edges
from llm.suffix_dedup import _gather


def test_owners_get_equal_shares():
    draw = np.random.default_rng(4)
    texts = ["".join(draw.choice(list("abcdefgh "), 4000)) for _ in range(100)]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts)], names=["doc_id", "print", "text"])
    for owners in (24, 64):
        keys = np.concatenate([np.frombuffer(k, "<u8") for u in _gather(200)(iter([batch])) for k in u.column("keys").to_pylist()])
        shares = np.bincount(np.searchsorted(owner_edges(owners), keys, side="right"), minlength=owners) / len(keys)
        assert len(keys) > 2000 and shares.max() < 2 / owners and shares.min() > 0.4 / owners
