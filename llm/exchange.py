"""Which 64-bit keys occur in more than one place: Golomb-coded key exchange with bitmap answers.

A *unit* is what one task has gathered: one key per item, in the items' order.  The key space is cut into
equal ranges, one per *owner*.  Every unit sends each owner its keys of that range, sorted and
Golomb-coded.  The owner finds keys that several units sent and answers each unit with one bit per
key, and one byte for the number of units of each key whose bit is set.  Only codes and answers travel;
what belongs to a key stays with its unit.

An owner gets a key at most once from a unit, so a key that fills a third of all rows reaches it once
per unit.  The number of owners follows the number of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import written

KEYS_PER_OWNER = 1_000_000
LEAST_OWNERS = 24
#: A task closes a unit when it holds so many keys.
KEYS_PER_UNIT = 1_000_000


def golomb_encode(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as Golomb-Rice coded gaps: quotients in unary, then remainders of equal width."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    span = int(keys[-1] // np.uint64(len(keys)))
    bits = max(span.bit_length() - 1, 0)
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(keys), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    low = gaps.astype(">u8").view(np.uint8).reshape(-1, 8)
    low = np.unpackbits(low, axis=1)[:, 64 - bits :] if bits else np.zeros((len(keys), 0), np.uint8)
    head = np.array([len(keys), bits, len(unary)], dtype="<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, dtype=np.uint64)
    n, bits, long = (int(x) for x in np.frombuffer(code[:24], dtype="<u8"))
    body = np.frombuffer(code, dtype=np.uint8, offset=24)
    cut = (long + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=long) == 0)
    quotients = np.diff(ends, prepend=-1) - 1
    low = np.zeros((n, 64), dtype=np.uint8)
    if bits:
        low[:, 64 - bits :] = np.unpackbits(body[cut:], count=n * bits).reshape(n, bits)
    gaps = np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps + (quotients.astype(np.uint64) << np.uint64(bits)))


def owner_edges(owners: int) -> np.ndarray:
    """First key of each owner but the first."""
    return np.array([(i << 64) // owners for i in range(1, owners)], dtype=np.uint64)


def _send(owners: int):
    edges = owner_edges(owners)
    schema = pa.schema([("owner", pa.int64()), ("unit", pa.int64()), ("code", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, keys in zip(batch.column("unit").to_pylist(), batch.column("keys")):
                keys = np.unique(np.frombuffer(keys.as_buffer(), dtype="<u8"))
                at = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(at))
                first = [keys[at[o] : at[o + 1]] - (edges[o - 1] if o else np.uint64(0)) for o in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([unit] * len(full), pa.int64()),
                     pa.array([golomb_encode(k) for k in first], pa.binary())], schema=schema,
                )

    return send


def _answer(part: pa.Table) -> pa.Table:
    """One owner: a bit per received key, set when another unit sent it too, and how many did (255: or more)."""
    lists = [golomb_decode(c.as_py()) for c in part.column("code")]
    _, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    times = np.split(np.minimum(times[place], 255).astype(np.uint8), np.cumsum([len(x) for x in lists])[:-1])
    hit = [i for i, t in enumerate(times) if (t > 1).any()]
    take = pa.array(hit, pa.int64())
    return pa.table(
        {
            "unit": part.column("unit").take(take),
            "owner": part.column("owner").take(take),
            "bits": pa.array([np.packbits(times[i] > 1).tobytes() for i in hit], pa.binary()),
            "times": pa.array([times[i][times[i] > 1].tobytes() for i in hit], pa.binary()),
        }
    )


def with_repeats(units: DataFrame) -> tuple[DataFrame, int]:
    """Add ``answers`` to a written table of units (``unit`` long, ``n_keys`` long, ``keys`` binary): an
    array of (owner, bits, times), null if no other unit has any of the unit's keys.  Also the number of owners.
    """
    total = units.agg(F.sum("n_keys")).first()[0] or 0
    owners = max(LEAST_OWNERS, -(-total // KEYS_PER_OWNER))
    sent = units.select("unit", "keys").mapInArrow(_send(owners), "owner long, unit long, code binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "unit long, owner long, bits binary, times binary")
    answers = written(answers, "answers").groupBy("unit").agg(F.collect_list(F.struct("owner", "bits", "times")).alias("answers"))
    return units.join(answers, "unit", "left"), owners


def occurrences(item_keys: np.ndarray, answers: list | None, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Per item of a unit: in how many units its key is (255: or more), and how often in this one."""
    keys, place, here = np.unique(item_keys, return_inverse=True, return_counts=True)
    units = np.ones(len(keys), dtype=np.int64)
    at = np.concatenate([[0], np.searchsorted(keys, owner_edges(owners)), [len(keys)]])
    for a in answers or []:
        lo, hi = at[a["owner"]], at[a["owner"] + 1]
        hit = np.flatnonzero(np.unpackbits(np.frombuffer(a["bits"], dtype=np.uint8), count=hi - lo))
        units[lo + hit] = np.frombuffer(a["times"], dtype=np.uint8)
    return units[place], here[place]


def repeated_items(item_keys: np.ndarray, answers: list | None, owners: int) -> np.ndarray:
    """Which items of a unit have a key that another item has, in this unit or another one."""
    units, here = occurrences(item_keys, answers, owners)
    return (units > 1) | (here > 1)
