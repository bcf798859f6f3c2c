"""Exact duplicates by Golomb-coded fingerprint exchange (operator 9).

Partitions keep their fingerprints and send them sorted and coded to owners; the owners' bitmaps say
which rows are suspects; only the suspects' texts are shuffled and compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import Units, discard, written
from llm.exchange import KEYS_PER_UNIT, repeated_items, with_repeats

_UNIT = pa.schema(
    [("unit", pa.int64()), ("n_keys", pa.int64()), ("keys", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("shas", pa.binary())]
)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, ids, shas = Units(), [], []

    def unit() -> pa.RecordBatch:
        joined = b"".join(shas)
        keys = np.ascontiguousarray(np.frombuffer(joined, dtype="<u8")[::4])
        row = [[number()], [len(keys)], [keys.tobytes()], [ids], [joined]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _UNIT)], schema=_UNIT)

    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        shas += [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in batch.column("text").cast(pa.large_binary())]
        if len(ids) >= KEYS_PER_UNIT:
            yield unit()
            ids, shas = [], []
    if ids:
        yield unit()


def _judge(owners: int) -> Callable:
    """Rows of a unit, each with its unit and place in it, and whether its fingerprint is repeated anywhere."""
    schema = pa.schema([("unit", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("suspect", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                suspect = repeated_items(np.frombuffer(r["keys"], dtype="<u8"), r["answers"], owners)
                n = len(suspect)
                shas = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(r["shas"])])
                columns = [np.full(n, r["unit"], np.int64), np.arange(n), pa.array(r["doc_ids"], pa.int64()), shas.cast(pa.binary()), suspect]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema)], schema=schema)

    return judge


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, an empty text is a text like others.  Of equal texts the row with the
    largest doc_id stays; null ids are smallest.  Of rows repeated with their id exactly one stays.
    ``text`` may be a column expression that normalises first.  Other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    schema = "unit long, n_keys long, keys binary, doc_ids array<long>, shas binary"
    units = written(texts.mapInArrow(_fingerprint, schema), "fingerprints")
    answered, owners = with_repeats(units)
    rows = answered.select("unit", "keys", "answers", "doc_ids", "shas").mapInArrow(
        _judge(owners), "unit long, place long, doc_id long, sha binary, suspect boolean"
    )
    rows = written(rows, "judged")
    row = F.struct("unit", "place")
    discard(units)
    suspects = rows.where("suspect").select("doc_id", "sha")
    # byte comparison: the suspects' texts meet by digest and text, summed up before the shuffle; the list of
    # suspects grows with the corpus, so it is never broadcast
    named = suspects.select(F.col("doc_id").alias("_id")).distinct()
    bodies = texts.join(named.hint("merge"), texts.doc_id.eqNullSafe(named._id), "left_semi")
    classes = bodies.groupBy(F.unhex(F.sha2("text", 256)).alias("sha"), "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    groups = classes.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("texts"))
    # digests of different texts would have to be equal for this: better no answer than a wrong one
    groups = groups.where("group_size > 1").select("sha", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts with one SHA-256"))).alias("group_size"))
    stays = rows.where("suspect").groupBy("sha", "doc_id").agg(F.min(row).alias("_first"))
    best = groups.alias("g").join(stays.alias("s"), F.expr("g.sha = s.sha AND g.keep_id <=> s.doc_id"), "left").select(
        F.col("g.sha").alias("_sha"), "keep_id", "group_size", "_first"
    )
    best = written(best, "groups")
    out = rows.join(best, rows.sha == best._sha, "left")
    alone = F.col("_sha").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (alone | (row == F.col("_first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns, whatever their names.

    Null text counts as empty; of rows repeated with their id and text exactly one stays; an empty table stays empty.
    """
    found = exact_duplicates(docs, doc_id, text)
    gone = found.where(~F.col("kept")).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_n"))
    twins = found.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    gone = gone.join(twins, F.expr("doc_id <=> _kept_id AND text_sha256 = _kept_sha"), "left")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("_kept_sha").isNotNull().alias("_twin"))
    gone = written(gone, "gone")
    sha = F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"), sha.alias("sha"))
    joined = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    once = joined.where("_twin").dropDuplicates(["id", "sha"]).select("row.*")
    return joined.where("_sha IS NULL").select("row.*").unionByName(once)
