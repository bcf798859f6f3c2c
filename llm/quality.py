"""Quality rules with compression bands (operator 7).

A text that repeats itself compresses far better than prose, and noise hardly at all.  The zstandard
ratio (compressed bytes / bytes) of the whole document and of its fixed chunks has to lie in a band
that depends on the length, since short inputs compress less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from llm.common import only
from llm.textbuf import Texts, mixed, slices_by_bytes

LEVEL = 3
CHUNK = 4096
#: From so many bytes on: lowest and highest ratio of a whole document.
WHOLE_BANDS = ((0, 0.0, 9.0), (200, 0.20, 0.92), (1_000, 0.16, 0.80), (4_000, 0.12, 0.72), (16_000, 0.08, 0.70))
#: The same for one chunk; a last chunk may be short.
CHUNK_BANDS = ((0, 0.0, 9.0), (1_000, 0.14, 0.82), (4_000, 0.10, 0.74))
#: Share of chunks outside their band above which a document goes.
BAD_CHUNKS = 0.5
#: Base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _grouped(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (owner, value), stable; and whether each entry there equals the one before it."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    same = np.zeros(len(o), dtype=bool)
    same[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    return order, same


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """The base counts of every text of a batch."""
    starts, ends, owner = t.words()

    def per_text(flags: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return running[t.bounds[1:]] - running[t.bounds[:-1]]

    point = (t.data & 0xC0) != 0x80  # first byte of a code point
    points = np.concatenate([[0], np.cumsum(point, dtype=np.int64)])
    out = {"n_words": t.counts(owner), "n_symbols": per_text(_SYMBOL[t.data])}
    out["word_chars"] = t.counts(owner, points[ends] - points[starts])

    breaks = np.flatnonzero(t.data == 0x0A)
    first = np.sort(np.concatenate([t.bounds[:-1], breaks + 1]))
    last = np.sort(np.concatenate([t.bounds[1:], breaks]))
    word = np.searchsorted(starts, first)
    full = (word < len(starts)) & (np.append(starts, np.iinfo(np.int64).max)[word] < last)
    first, last = first[full], last[full]
    line_owner = t.owner(first)
    order, same = _grouped(line_owner, t.hash_of(first, last))
    out["n_dup_lines"] = t.counts(line_owner[order][same])

    repeated = np.zeros(len(starts), dtype=bool)
    if len(starts) >= 3:
        h = t.hash_of(starts, ends)
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        window = mixed(h[:-2] + mixed(h[1:-1] + mixed(h[2:])))[inside]
        order, same = _grouped(owner[inside], window)
        twice = same.copy()
        twice[:-1] |= same[1:]
        at = inside[order[twice]]
        for k in range(3):
            repeated[at + k] = True
    out["n_repeat_words"] = t.counts(owner[repeated])
    return out


def _band(bands: tuple, size: int) -> tuple[float, float]:
    return next((lo, hi) for least, lo, hi in reversed(bands) if size >= least)


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of chunks outside their band, and the verdict."""
    if not text:
        return 1.0, 0.0, False
    whole = len(packer.compress(text)) / len(text)
    lo, hi = _band(WHOLE_BANDS, len(text))
    if len(text) <= CHUNK:
        return whole, 0.0, lo <= whole <= hi
    bad = chunks = 0
    for at in range(0, len(text), CHUNK):
        chunk = text[at : at + CHUNK]
        low, high = _band(CHUNK_BANDS, len(chunk))
        bad += not low <= len(packer.compress(chunk)) / len(chunk) <= high
        chunks += 1
    return whole, bad / chunks, lo <= whole <= hi and bad <= BAD_CHUNKS * chunks


def verdicts(column: pa.Array) -> dict[str, np.ndarray]:
    t, packer = Texts(column), zstandard.ZstdCompressor(level=LEVEL)
    out = base_counts(t)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
    packed = [compression(t.text(i), packer) for i in range(t.n)]
    out["zstd_ratio"] = np.array([p[0] for p in packed])
    out["bad_chunks"] = np.array([p[1] for p in packed])
    out["kept"] = ~out["base_failed"] & np.array([p[2] for p in packed], dtype=bool)
    return out


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, zstd_ratio, bad_chunks, kept.

    Null and empty texts have no words, so they fail the base rules.  Repeated rows are judged alike,
    each by itself; a null id stays null.  Other columns are not read.
    """
    out_type = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, zstd_ratio double, bad_chunks double"
    names = [c.split()[0] for c in out_type.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                found = verdicts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(found[n]) for n in names[1:]]], names=names)

    return only(docs, doc_id=f"{doc_id} long", text=f"{text} string").mapInArrow(judge, out_type)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns; no shuffle."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, text):
                yield part.filter(pa.array(verdicts(part.column(text))["kept"]))

    return docs.mapInArrow(judge, docs.schema)
