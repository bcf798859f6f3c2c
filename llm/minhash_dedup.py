"""Near-duplicates by MinHash with tensored banding (operator 12).

Two small collections of ``tables`` keys, of ``rows`` minhashes each, give tables ** 2 table keys: one for every pair
of a key of the first and a key of the second collection.  So 2 * tables * rows minhashes serve for
tables ** 2 tables of 2 * rows minhashes.  Two sets of similarity s miss each other in all tables with a chance of
less than 2 * (1 - s ** rows) ** tables: 1e-5 at 0.8 with the settings below.

Only table keys that several sets have leave their task (Golomb-coded exchange).  Then, on full sets:

1. The set with the most company over its tables is the hub of a table.  Every set is compared with the hub that
   it meets most often; these links are a star per group, not its pairs.
2. Tables whose sets are not all in one component by then are settled exactly: their sets meet on their rarest
   n-grams (prefix and position filter), across components only.  A parity map of 1,024 bits, in which each n-gram
   turns one bit, bounds from below in how many n-grams two sets differ; pairs that it leaves are compared in full.

Equal sets are one vertex from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import Units, discard, only, written
from llm.components import components
from llm.exchange import KEYS_PER_UNIT, occurrences, repeated_items, with_repeats
from llm.ngram_join import Shingles
from llm.textbuf import mixed, slices_by_bytes

#: Keys of each small collection, and minhashes of each key.
TABLES, ROWS = 12, 2
#: Bits of a set's parity map, in words of 64.
PARITY_WORDS = 16
#: Pairs of one set that meet one copy of it.
PAIRS_PER_COPY = 2000


def table_keys(s: Shingles, sets: np.ndarray, tables: int = TABLES, rows: int = ROWS) -> np.ndarray:
    """tables ** 2 keys for each of the given sets, none of them empty."""
    halves = []
    for side in range(2):
        keys = np.zeros((len(sets), tables), dtype=np.uint64)
        for t in range(tables):
            for r in range(rows):
                seed = mixed(np.array([1 + r + rows * (t + tables * side)], dtype=np.uint64))
                least = np.minimum.reduceat((s.value ^ seed) * (seed | np.uint64(1)), s.bounds[sets])
                keys[:, t] = mixed(keys[:, t] * np.uint64(3) + least + seed)
        halves.append(keys)
    number = mixed(np.arange(1, tables * tables + 1, dtype=np.uint64)).reshape(1, tables, tables)
    return mixed(halves[0][:, :, None] * np.uint64(3) + mixed(halves[1][:, None, :] ^ number)).reshape(len(sets), -1)


def _gather(width: int, tables: int, rows: int) -> Callable:
    """Units: documents with size and vertex, and of each distinct set in it the table keys."""
    schema = pa.schema(
        [("unit", pa.int64()), ("n_keys", pa.int64()), ("keys", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("prints", pa.list_(pa.int64())),
         ("sizes", pa.list_(pa.int64())), ("vertices", pa.list_(pa.int64())), ("sets", pa.binary())]
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Units()
        ids, prints, sizes, vertices, keys, sets, seen = [], [], [], [], [], [], set()

        def unit() -> pa.RecordBatch:
            joined = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            row = [number(), len(joined), joined.tobytes(), ids, prints, sizes, vertices, np.array(sets, "<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                s = Shingles(part.column("text"), width)
                ids += part.column("doc_id").to_pylist()
                prints += part.column("print").to_pylist()
                sizes += s.sizes.tolist()
                vertices += s.vertex.tolist()
                new = []
                for i in np.flatnonzero(s.sizes).tolist():
                    vertex = int(s.vertex[i])
                    if vertex not in seen:
                        seen.add(vertex)
                        new.append(i)
                        sets.append(vertex)
                if new:
                    every = np.flatnonzero(s.sizes)  # minima run from one set to the next
                    keys.append(table_keys(s, every, tables, rows)[np.searchsorted(every, new)].ravel())
                if len(sets) * tables * tables >= KEYS_PER_UNIT or len(ids) >= KEYS_PER_UNIT:
                    yield unit()
                    ids, prints, sizes, vertices, keys, sets, seen = [], [], [], [], [], [], set()
        if ids:
            yield unit()

    return gather


def _met(owners: int) -> Callable:
    """(key, vertex) of the table keys that another set, or the same set in another unit, has."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, sets = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["sets"], "<i8")
                if len(sets):
                    hit = repeated_items(keys, r["answers"], owners)
                    of = np.repeat(sets, len(keys) // len(sets))[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array(of)], names=["key", "vertex"])

    return met


def _sets_of(width: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                s = Shingles(part.column("text"), width)
                asked = np.flatnonzero(s.vertex == part.column("vertex").to_numpy())  # an id may have other texts too
                grams = [s.value[s.bounds[i] : s.bounds[i + 1]].view(np.int64) for i in asked]
                yield pa.RecordBatch.from_arrays([pa.array(s.vertex[asked]), pa.array(grams, pa.list_(pa.int64()))], names=["vertex", "grams"])

    return sets


def _with_set(pairs: DataFrame, sets: DataFrame, side: str, name: str) -> DataFrame:
    """Pairs with the set of one side; a set of many pairs is met by several copies of it."""
    copies = pairs.groupBy(F.col(side).alias("_v")).agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("_copies"))
    held = sets.join(copies, F.col("vertex") == F.col("_v")).select("_v", "_copies", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), F.col("grams").alias(name))
    other = "b" if side == "a" else "a"
    spread = pairs.join(copies.withColumnsRenamed({"_v": "_w", "_copies": "_n"}), F.col(side) == F.col("_w"))
    spread = spread.withColumn("_at", F.pmod(F.xxhash64(other), F.col("_n").cast("long")).cast("int")).drop("_w", "_n")
    return spread.join(held, (F.col(side) == F.col("_v")) & (F.col("_at") == F.col("_copy"))).drop("_v", "_copies", "_copy", "_at")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    common = F.size(F.array_intersect("_x", "_y")).cast("long")
    both = _with_set(_with_set(pairs, sets, "a", "_x"), sets, "b", "_y").withColumn("_common", common)
    return both.where(100 * F.col("_common") >= percent * (F.size("_x") + F.size("_y") - F.col("_common"))).select("a", "b")


def _units_of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["unit", "n_keys", "vertices", "labels", "sizes", "keys"], [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    number, vertices, labels, sizes, grams, held = Units(), [], [], [], [], 0

    def unit() -> pa.RecordBatch:
        row = [number(), held, vertices, labels, sizes, np.concatenate(grams).astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    for batch in batches:
        for v, label, g in zip(batch.column("vertex").to_pylist(), batch.column("label").to_pylist(), batch.column("grams")):
            vertices.append(v)
            labels.append(label)
            grams.append(g.values.to_numpy())
            sizes.append(len(grams[-1]))
            held += sizes[-1]
            if held >= KEYS_PER_UNIT:
                yield unit()
                vertices, labels, sizes, grams, held = [], [], [], [], 0
    if vertices:
        yield unit()


def parity(grams: np.ndarray) -> np.ndarray:
    """Bit b of the map tells whether an odd number of n-grams fall on b: two maps differ in no more bits than their sets in n-grams."""
    odd = np.bincount((mixed(grams) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _prefixes(percent: int, owners: int) -> Callable:
    """(gram, vertex, label, size, place, parity words) of the first n-grams of each set, from rare to frequent.

    Linked sets have one of the first size - least overlap + 1 in common.  The order is that of the number of units
    that have the n-gram; inside one unit, where all its sets are, of their number; then of its hash.
    """
    names = ["gram", "vertex", "label", "size", "place", *[f"w{k}" for k in range(PARITY_WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams, sizes = np.frombuffer(r["keys"], "<u8"), np.array(r["sizes"], dtype=np.int64)
                units, here = occurrences(grams, r["answers"], owners)
                rank = np.where(units > 1, units << 32, here)
                of = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((grams, rank, of))
                place = np.arange(len(order)) - (np.cumsum(sizes) - sizes)[of]
                some = (place < (sizes + (-sizes * percent // 100) + 1)[of]) & (rank[order] > 1)
                mine = of[some]
                maps = np.stack([parity(g) for g in np.split(grams, np.cumsum(sizes)[:-1])])
                columns = [grams[order[some]].view(np.int64), np.array(r["vertices"])[mine], np.array(r["labels"])[mine], sizes[mine], place[some], *maps[mine].T]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return run


def _across(unsettled: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can be linked, of sets (vertex, label, grams)."""
    units = written(unsettled.mapInArrow(_units_of_sets, "unit long, n_keys long, vertices array<long>, labels array<long>, sizes array<long>, keys binary"), "unsettled")
    answered, owners = with_repeats(units)
    words = [f"w{k}" for k in range(PARITY_WORDS)]
    schema = ", ".join(f"{c} long" for c in ("gram", "vertex", "label", "size", "place", *words))
    first = answered.select("vertices", "labels", "sizes", "keys", "answers").mapInArrow(_prefixes(percent, owners), schema)
    first = written(first, "first")
    discard(units)
    mixed_grams = first.groupBy(F.col("gram").alias("_gram")).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo != _hi")
    held = first.join(mixed_grams, F.col("gram") == F.col("_gram"), "left_semi")
    most = "least(x.size - x.place, y.size - y.place)"  # of what two sets can share from their first common n-gram on
    differ = " + ".join(f"bit_count(x.{w} ^ y.{w})" for w in words)
    can = F.expr(
        f"x.gram = y.gram AND x.vertex < y.vertex AND x.label != y.label AND 100 * {most} >= {percent} * (x.size + y.size - {most}) "
        f"AND 100 * (x.size + y.size - ({differ})) >= {percent} * (x.size + y.size + ({differ}))"
    )
    return held.alias("x").join(held.alias("y"), can).select(F.col("x.vertex").alias("a"), F.col("y.vertex").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 4, percent: int = 80, doc_id: str = "doc_id", text: str = "text", tables: int = TABLES, rows: int = ROWS
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (whether it is its component's id).

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text with fewer words than ``width`` is
    one n-gram; without words, or null, it has none and is linked with nothing.  component_id is the least doc_id that
    links reach.  Repeated rows are alike.  A null id is a component's id only where there is no other; it is then
    kept.  An empty table gives no rows; other columns are not read.  Sets are held as 64-bit n-gram hashes, a text's
    whole set in one row.
    """
    texts = only(docs, doc_id=f"{doc_id} long", text=f"{text} string").withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))
    schema = "unit long, n_keys long, keys binary, doc_ids array<long>, prints array<long>, sizes array<long>, vertices array<long>, sets binary"
    units = written(texts.mapInArrow(_gather(width, tables, rows), schema), "keys")
    listed = units.select(F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("prints").alias("print"), F.col("sizes").alias("n_shingles"), F.col("vertices").alias("vertex"))))
    listed = written(listed.toDF("doc_id", "print", "n_shingles", "vertex"), "rows")
    answered, owners = with_repeats(units)
    met = written(answered.select("keys", "answers", "sets").mapInArrow(_met(owners), "key long, vertex long").distinct(), "met")
    discard(units)

    # company of every set over its tables, and the hub of every table
    size = met.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    held = written(met.join(size, F.col("key") == F.col("_key")).drop("_key"), "tables")
    discard(met)
    company = held.groupBy(F.col("vertex").alias("_v")).agg(F.sum("n").alias("company"))
    known = held.join(company, F.col("vertex") == F.col("_v"))
    hubs = known.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("company", "vertex")).alias("_hub"))
    meet = held.join(hubs, F.col("key") == F.col("_key")).select("vertex", F.col("_hub.vertex").alias("hub")).where("vertex != hub")
    meet = meet.groupBy("vertex", "hub").agg(F.count("*").alias("times"))
    star = meet.groupBy(F.col("vertex").alias("a")).agg(F.max(F.struct("times", "hub")).alias("_best")).select("a", F.col("_best.hub").alias("b"))
    star = written(star, "star")

    classes = written(listed.where("n_shingles > 0").groupBy("vertex").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print")).alias("row")), "classes")
    asked = held.select(F.col("vertex").alias("_v")).distinct()
    asked = classes.join(asked, F.col("vertex") == F.col("_v"), "left_semi").select(F.col("row.doc_id").alias("_id"), F.col("row.print").alias("_print"), "vertex")
    bodies = texts.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")))
    bodies = bodies.dropDuplicates(["_id", "_print", "vertex"]).select("text", "vertex")
    sets = written(bodies.mapInArrow(_sets_of(width), "vertex long, grams array<long>"), "sets")

    close = written(linked(star, sets, percent), "links")
    label = components(close).withColumnRenamed("vertex", "_v")
    marked = written(held.join(label, F.col("vertex") == F.col("_v"), "left").select("key", "vertex", F.coalesce("label", "vertex").alias("label")), "marked")
    discard(held)
    open_tables = marked.groupBy(F.col("key").alias("_key")).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo != _hi")
    unsettled = marked.join(open_tables, F.col("key") == F.col("_key"), "left_semi").select(F.col("vertex").alias("_v"), "label").distinct()
    unsettled = sets.join(unsettled, F.col("vertex") == F.col("_v")).select("vertex", "label", "grams")
    pairs = written(_across(unsettled, percent), "pairs")
    more = written(linked(pairs, sets, percent), "more_links")
    discard(sets, marked)

    joined = components(close.unionByName(more))
    labelled = classes.join(joined.withColumnRenamed("vertex", "_v"), F.col("vertex") == F.col("_v"), "left").select("vertex", "least", F.coalesce("label", "vertex").alias("label"))
    least = labelled.groupBy(F.col("label").alias("_label")).agg(F.min("least").alias("component_id"))
    known = labelled.join(least, F.col("label") == F.col("_label")).select(F.col("vertex").alias("_v"), "component_id")
    out = listed.join(known, (F.col("vertex") == F.col("_v")) & (F.col("n_shingles") > 0), "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
