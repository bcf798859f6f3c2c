"""Token counts from the exact length histogram (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from llm.common import only, written
from llm.encoding import encoder, ids
from llm.textbuf import slices_by_bytes

#: Lengths that share one step of the suffix sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, ranks: str, pattern: str, added: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens.  Null and empty texts have 0 tokens; repeated rows count each time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern, added)
        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                sizes = np.array([len(ids(enc, t)) for t in part.column("text").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes)], names=["doc_id", "n_tokens"])

    return only(docs, doc_id=f"{doc_id} long", text=f"{text} string").mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, by: tuple[str, ...] = (), n_tokens: str = "n_tokens") -> DataFrame:
    """One row per length that occurs (per group ``by``), with what holds at that context limit.

    n_tokens, n_docs, tokens; docs_longer and tokens_longer (documents above the limit); docs_at_most
    and tokens_at_most; truncated_total (tokens left when every document is cut there); share_at_most
    (so the q-quantile is the least length with a share of q or more); total_docs, total_tokens.

    Documents are summed up per length before the shuffle.  Suffix sums run inside blocks of
    ``BLOCK`` lengths; only block totals, at most longest / ``BLOCK`` rows, meet in one window.
    Rows with a null length are left out; an empty table gives an empty histogram.
    """
    hist = lengths.where(F.col(n_tokens).isNotNull()).groupBy(*by, F.col(n_tokens).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    hist = written(hist, "histogram")  # one row per length: texts are encoded once
    hist = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    later = whole.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    blocks = hist.groupBy(*by, "_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    blocks = blocks.select(
        *[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_of"),
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("total_docs"), F.sum("_t").over(whole).alias("total_tokens"),
    )
    same = F.col("_block") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    above = Window.partitionBy(*by, "_block").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    out = hist.join(blocks, same)
    out = out.withColumn("docs_longer", F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("_docs_after"))
    out = out.withColumn("tokens_longer", F.coalesce(F.sum("tokens").over(above), F.lit(0)) + F.col("_tokens_after"))
    out = out.withColumn("docs_at_most", F.col("total_docs") - F.col("docs_longer"))
    out = out.withColumn("tokens_at_most", F.col("total_tokens") - F.col("tokens_longer"))
    out = out.withColumn("truncated_total", F.col("tokens_at_most") + F.col("n_tokens") * F.col("docs_longer"))
    out = out.withColumn("share_at_most", F.col("docs_at_most") / F.col("total_docs"))
    return out.select(
        *by, "n_tokens", "n_docs", "tokens", "docs_longer", "tokens_longer", "docs_at_most", "tokens_at_most",
        "truncated_total", "share_at_most", "total_docs", "total_tokens",
    )


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that covers ``share`` of the documents."""
    return histogram.where(F.col("share_at_most") >= share).agg(F.min("n_tokens").alias("n_tokens"))
