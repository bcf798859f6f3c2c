"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2), all in DataFrame functions.

Each document draws an exponential key, divided by its quality weight.  Sorted by key within the source,
documents are taken until their running size reaches the source's token budget.  A budget above the
source's size is served by complete epochs first; only the rest is sampled.

The running sums end in one cut per source: the last place that is taken.  Whether a document is taken is
then a comparison with its source's cut, so texts are never sorted or joined by id.  A place is key, id, size,
hash of the text, and the row's number in the written table of draws, so that no two rows share one: of
equal rows as many are taken as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from llm.common import WORD, written
from riskloom.functions.rowindex import with_running_sum

MOST_EPOCHS = 3
#: What orders the rows of a source.
PLACE = ("key", "doc_id", "size", "print", "row")
#: Rows of one source that meet one copy of its line.
ROWS_PER_PART = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that the id and the seed fix: 13 hexadecimal digits of a digest."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, weight, target for a table (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  Targets share ``share`` of all sizes by
    weight; one above ``most`` times its source's size stops there and the excess is shared again.  So
    targets are least(cap, level * weight) for one level: with sources in order of cap / weight it is the
    first that leaves its own source below its cap.  If all caps are too small, all targets are caps.
    The windows run over one row per source: as many as there are target weights.
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    rows = sizes.select("source", "source_size", ((place - 1) % 3 + 1).cast("double").alias("weight"))
    rows = rows.withColumn("_cap", most * F.col("source_size").cast("double"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = every.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - before) / rest
    rows = rows.withColumn("_level", level).withColumn("_place", F.row_number().over(order))
    found = F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_place"))).over(every)
    target = F.least("_cap", F.coalesce(found, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _with_source(rows: DataFrame, per_source: DataFrame, parts: int) -> DataFrame:
    """Rows with their source's line of ``per_source``.

    A source may hold a third of all rows, so it is met by ``parts`` copies of its line; rows choose one
    by their key.
    """
    line = per_source.select(F.col("source").alias("_source"), *[c for c in per_source.columns if c != "source"], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")  # not the id: it may be null in most rows
    return rows.withColumn("_at", part).join(line, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_part"))).drop("_source", "_at", "_part")


def draws(docs: DataFrame, weight: Column, seed: int, doc_id: str, size: Column, source: str, text: str, *carried: Column) -> DataFrame:
    """doc_id, source, size, key, print and row of every document; a null weight counts as 1, others have to be positive.

    ``row`` numbers the rows and holds only in a written table; ``print`` is the hash of the text if there is one.
    """
    ident = F.col(f"`{doc_id}`").cast("long")
    return docs.select(
        ident.alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), size.cast("long").alias("size"),
        (-F.log(uniform(ident, seed)) / F.coalesce(weight.cast("double"), F.lit(1.0))).alias("key"),
        (F.xxhash64(F.col(f"`{text}`").cast("string")) if text in docs.columns else F.lit(0).cast("long")).alias("print"),
        F.monotonically_increasing_id().alias("row"), *carried,
    )


def _parts(drawn: DataFrame) -> int:
    return 1 + drawn.count() // ROWS_PER_PART


def cuts(drawn: DataFrame, share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source: source_size, target, whole epochs, and the last place of the sampled part.

    A document belongs to the sampled part when more than half of it lies inside the remaining budget,
    so a source misses its target by half a document at most.
    """
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    parts = _parts(drawn)
    sums = with_running_sum(drawn.select("source", *PLACE), list(PLACE), "size", ["source"], "_upto")
    inside = _with_source(sums, targets.select("source", "rest"), parts).where((F.col("_upto") - F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0))
    last = inside.groupBy("source").agg(F.max(F.struct(*PLACE)).alias("last"))
    last = last.withColumnRenamed("source", "_source")
    return targets.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "rest")


def _epochs_taken() -> Column:
    mine = F.struct(*PLACE)
    return F.col("epochs") + F.when(F.col("last").isNotNull() & (mine <= F.col("last")), 1).otherwise(0)


def mix(
    docs: DataFrame, weight: Column | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs_taken, taken.

    The size is the number of words of ``text``, or what the column ``size`` already holds.
    Null text has size 0, a null source is a source of its own, a null id draws like an id.  Rows that
    repeat an id share their draw; the source's cut may fall between them, so its target is met to half a
    document all the same.  An empty table gives no rows.  Other columns are not read.
    """
    counted = n_words(F.col(f"`{text}`")) if size is None else F.col(f"`{size}`")
    drawn = written(draws(docs, F.lit(1.0) if weight is None else weight, seed, doc_id, counted, source, text), "draws")
    out = _with_source(drawn, cuts(drawn), _parts(drawn)).withColumn("epochs_taken", _epochs_taken().cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs_taken", (F.col("epochs_taken") * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, weight: Column | None = None, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns, whatever their names.

    Null texts, sources and ids, and repeated rows, are treated as in :func:`mix`; an empty table gives no rows.
    Rows and draws are written together, so a text is read and counted once and each row keeps its number.
    """
    counted = n_words(F.col(f"`{text}`")) if size is None else F.col(f"`{size}`")
    # the row is one column of numbered fields, so that its names cannot clash with those below or one another
    fields = [f"c{i}" for i in range(len(docs.columns))]
    carried = F.struct(*[F.col(f"`{c}`").alias(f) for c, f in zip(docs.columns, fields)]).alias("whole")
    drawn = written(draws(docs, F.lit(1.0) if weight is None else weight, seed, doc_id, counted, source, text, carried), "draws")
    line = written(cuts(drawn).select("source", "epochs", "last"), "cuts")
    taken = _with_source(drawn, line, _parts(drawn)).select("whole", _epochs_taken().cast("int").alias("times")).where("times > 0")
    return taken.select("whole", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("whole.*").toDF(*docs.columns)
