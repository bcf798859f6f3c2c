"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.runtime import cut, discard  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from there: lineage ends, lost executors cost one stage."""
    return cut(df, name)


class Units:
    """Numbers for the pieces of work that a task writes: the same again when the task runs again."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 24

    def __call__(self) -> int:
        self.next += 1
        return self.next


def whole_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in schema], schema=schema)


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under their internal names and types, so that other columns cannot clash."""
    return docs.select(*[F.col(f"`{c.split()[0]}`").cast(c.split()[1]).alias(name) for name, c in columns.items()])
