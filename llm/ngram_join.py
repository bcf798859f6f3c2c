"""Jaccard join on word n-grams with vertical partitioning (operator 3).

All n-grams have one global order, that of their 64-bit hashes.  The order is cut into F equal fragments
(F a power of two that follows the set's size), and so is every set, into segments.  Sets that are
similar enough differ in at most ``d`` n-grams, so they have at least F - d of F segments in common:

1. Per fragment: segments travel as hashes, and only those that several sets have (Golomb-coded exchange).
2. Over the fragments: with segments ordered from rare to frequent, linked sets share one among their first
   d + 1.  A set whose d + 1 rarest segments are its own is alone; this ends most sets.
3. The rest does the same with single n-grams, from rare to frequent: linked sets share one of the first
   few.  Shared ones tie sets to groups.
4. Inside a group (or a pair of its blocks) overlaps are counted fragment by fragment, summed per pair, and
   compared with the threshold exactly.

Equal sets are one vertex from the start.  Links leave a group as a spanning forest and link counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from llm.common import Units, discard, only, written
from llm.components import components
from llm.exchange import KEYS_PER_UNIT, occurrences, repeated_items, with_repeats
from llm.textbuf import Texts, mixed, slices_by_bytes

#: Sets of a group that are compared in one step with themselves or those of another block.
BLOCK = 512
#: Fragments of the n-gram order in which overlaps are counted.
FRAGMENTS = 8
#: Distinct shared n-grams whose overlaps are counted at once.
COLUMNS = 8192


class Shingles:
    """Distinct n-gram hashes of every text of a batch: ``value`` sorted inside ``owner``."""

    def __init__(self, column: pa.Array, width: int):
        t = Texts(column, lower=True)
        starts, ends, owner = t.words()
        words = t.counts(owner)
        h = t.hash_of(starts, ends)
        n = len(h)
        gram = h[: max(n - width + 1, 0)].copy()
        for k in range(1, width):
            gram = mixed(gram * np.uint64(2 * k + 1) + h[k : n - width + 1 + k])
        inside = owner[width - 1 :] == owner[: max(n - width + 1, 0)] if n >= width else np.zeros(0, bool)
        value, of = gram[inside], owner[: len(gram)][inside]
        # fewer words than an n-gram has: the whole sequence is one
        short = np.flatnonzero((words > 0) & (words < width))
        if len(short):
            first = np.searchsorted(owner, short)
            whole = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                there = words[short] > k
                whole[there] = mixed(whole[there] * np.uint64(3) + h[(first + k)[there]] + np.uint64(width + k))
            value, of = np.concatenate([value, whole]), np.concatenate([of, short])
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        self.value, self.owner, self.n_texts = value[new], of[new], t.n
        self.bounds = np.searchsorted(self.owner, np.arange(t.n + 1))
        self.sizes = np.diff(self.bounds)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.value))])
        #: One number per set; equal sets have equal ones.
        self.vertex = mixed(self.sums[self.bounds[1:]] - self.sums[self.bounds[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def segments(self, texts: np.ndarray, fragments: np.ndarray) -> np.ndarray:
        """Hashes of the segments of the given texts, ``fragments`` of them each, one after the other."""
        base = np.concatenate([[0], np.cumsum(fragments)])
        slot = np.full(self.n_texts, -1)
        slot[texts] = np.arange(len(texts))
        here = slot[self.owner] >= 0
        mine = slot[self.owner[here]]
        f = (self.value[here] >> np.uint64(32)) * fragments[mine].astype(np.uint64) >> np.uint64(32)
        cut = np.searchsorted(base[mine] + f.astype(np.int64), np.arange(base[-1] + 1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.value[here]))])
        total = np.repeat(fragments, fragments).astype(np.uint64)
        number = (np.arange(base[-1]) - np.repeat(base[:-1], fragments)).astype(np.uint64)
        return mixed(sums[cut[1:]] - sums[cut[:-1]] + mixed(number + (total << np.uint64(32))))


class Threshold:
    """Similarity as a percentage: linked when 100 * common >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def differing(self, size: np.ndarray) -> np.ndarray:
        """Most n-grams in which a linked pair differs, when its smaller set has ``size`` of them."""
        return size * (100 - self.percent) // self.percent

    def fragments(self, size: np.ndarray) -> np.ndarray:
        """The least power of two above :meth:`differing`."""
        return (1 << np.ceil(np.log2(self.differing(size) + 1)).astype(np.int64)).astype(np.int64)

    def partner(self, size: np.ndarray) -> np.ndarray:
        """Least size of a linked set."""
        return -(-size * self.percent // 100)

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (a + b - common)


def _gather(width: int, limit: Threshold) -> Callable:
    """Units: documents with size and vertex; of each distinct set in it the segments, on its own grid and,
    where a smaller partner could have a coarser one, on that."""
    schema = pa.schema(
        [("unit", pa.int64()), ("n_keys", pa.int64()), ("keys", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("shas", pa.list_(pa.binary())),
         ("sizes", pa.list_(pa.int64())), ("vertices", pa.list_(pa.int64())), ("sets", pa.binary())]
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Units()

        def fresh() -> tuple:
            return [], [], [], [], [], [], set(), [0]

        ids, shas, sizes, vertices, sets, segments, seen, held = fresh()

        def unit() -> pa.RecordBatch:
            joined = np.concatenate(segments) if segments else np.zeros(0, np.uint64)
            about = np.concatenate(sets) if sets else np.zeros((0, 3), np.int64)
            row = [number(), len(joined), joined.tobytes(), ids, shas, sizes, vertices, about.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                s = Shingles(part.column("text"), width)
                ids += part.column("doc_id").to_pylist()
                shas += [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in part.column("text").cast(pa.large_binary())]
                sizes += s.sizes.tolist()
                vertices += s.vertex.tolist()
                new = []
                for i in np.flatnonzero(limit.differing(s.sizes) > 0):
                    if s.vertex[i] not in seen:
                        seen.add(s.vertex[i])
                        new.append(i)
                own = np.array(new, dtype=np.int64)
                least = limit.partner(s.sizes[own])
                other = (limit.differing(least) > 0) & (limit.fragments(least) < limit.fragments(s.sizes[own]))
                for pick, grid in ((own, limit.fragments(s.sizes[own])), (own[other], limit.fragments(least[other]))):
                    if len(pick):
                        segments.append(s.segments(pick, grid))
                        sets.append(np.stack([s.vertex[pick], s.sizes[pick], grid], axis=1).astype(np.int64))
                        held[0] += int(grid.sum())
                if held[0] >= KEYS_PER_UNIT or len(ids) >= KEYS_PER_UNIT:
                    yield unit()
                    ids, shas, sizes, vertices, sets, segments, seen, held = fresh()
        if ids:
            yield unit()

    return gather


def _shared(owners: int) -> Callable:
    """(vertex, size, fragments, segment) for the segments that more than one set of the unit, or another unit, has."""
    names = ["vertex", "size", "fragments", "segment"]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                joined, about = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["sets"], "<i8").reshape(-1, 3)
                hit = repeated_items(joined, r["answers"], owners)
                of = np.repeat(np.arange(len(about)), about[:, 2])[hit]
                for at in range(0, len(of), 100_000):
                    part = about[of[at : at + 100_000]]
                    columns = [*part.T, joined[hit][at : at + 100_000].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return shared


def _sets_of(width: int) -> Callable:
    """Units of the listed sets (text, vertex, copies): vertices, copies and sizes, n-gram hashes as keys."""
    names = ["unit", "n_keys", "vertices", "copies", "sizes", "keys"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, vertices, copies, sizes, grams, held = Units(), [], [], [], [], 0

        def unit() -> pa.RecordBatch:
            row = [number(), held, vertices, copies, sizes, np.concatenate(grams).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                s = Shingles(part.column("text"), width)
                asked = np.flatnonzero(s.vertex == part.column("vertex").to_numpy())  # an id may have other texts too
                vertices += s.vertex[asked].tolist()
                copies += part.column("copies").take(pa.array(asked)).to_pylist()
                sizes += s.sizes[asked].tolist()
                grams += [s.value[s.bounds[i] : s.bounds[i + 1]] for i in asked]
                held += int(s.sizes[asked].sum())
                if held >= KEYS_PER_UNIT:
                    yield unit()
                    vertices, copies, sizes, grams, held = [], [], [], [], 0
        if vertices:
            yield unit()

    return run


def _prefixes(limit: Threshold, owners: int) -> Callable:
    """vertex, copies, n-grams and first shared n-grams of the sets that have any.

    Order: number of units that have the n-gram; inside one unit, where all its sets are, their number; hash.
    """
    names = ["vertex", "copies", "grams", "first"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams, sizes = np.frombuffer(r["keys"], "<u8"), np.array(r["sizes"], dtype=np.int64)
                units, here = occurrences(grams, r["answers"], owners)
                rank = np.where(units > 1, units << 32, here)
                of = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((grams, rank, of))
                begin = np.cumsum(sizes) - sizes
                place = np.arange(len(order)) - begin[of]
                some = (place < (sizes - limit.partner(sizes) + 1)[of]) & (rank[order] > 1)
                shared, owner = grams[order[some]].view(np.int64), of[some]
                at = np.searchsorted(owner, np.arange(len(sizes) + 1))
                rows = [
                    (r["vertices"][i], r["copies"][i], grams[begin[i] : begin[i] + sizes[i]].tobytes(), shared[at[i] : at[i + 1]].tolist())
                    for i in np.flatnonzero(np.diff(at))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every left with every right set: counted per fragment of the order, then summed."""
    total = np.zeros((len(left), len(right)), dtype=np.int64)

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (a, of_a), (b, of_b) = flat(left), flat(right)
    fragment_a, fragment_b = (x >> np.uint64(64 - FRAGMENTS.bit_length() + 1) for x in (a, b))
    for f in range(FRAGMENTS):
        here_a, here_b = fragment_a == f, fragment_b == f
        common = np.intersect1d(a[here_a], b[here_b])
        for at in range(0, len(common), COLUMNS):
            some = common[at : at + COLUMNS]

            def table(values: np.ndarray, owners: np.ndarray, rows: int, some: np.ndarray = some) -> np.ndarray:
                place = np.minimum(np.searchsorted(some, values), len(some) - 1)
                hit = some[place] == values
                out = np.zeros((rows, len(some)), dtype=np.float32)
                out[owners[hit], place[hit]] = 1
                return out

            partial = table(a[here_a], of_a[here_a], len(left)) @ table(b[here_b], of_b[here_b], len(right)).T
            total += partial.astype(np.int64)
    return total


def _compare(limit: Threshold) -> Callable:
    """One block pair: a forest of its links and, per set, the number of documents it is linked with."""

    def compare(part: pa.Table) -> pa.Table:
        side = part.column("side").to_numpy()
        vertex, copies = part.column("vertex").to_numpy(), part.column("copies").to_numpy()
        grams = [np.frombuffer(g.as_buffer(), "<u8") for g in part.column("grams")]
        size = np.array([len(g) for g in grams], dtype=np.int64)
        one, two = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # side 0: both
        edges, links = [], np.zeros(len(vertex), dtype=np.int64)
        label = np.arange(len(vertex))

        def root(i: int) -> int:
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        if len(one) and len(two):
            common = overlaps([grams[i] for i in one], [grams[i] for i in two])
            linked = limit.linked(common, size[one][:, None], size[two][None, :]) & (vertex[one][:, None] != vertex[two][None, :])
            links[one] += linked @ copies[two]
            if side.any():
                links[two] += copies[one] @ linked
            for i, j in zip(*np.nonzero(linked)):
                x, y = root(one[i]), root(two[j])
                if x != y:
                    label[x] = y
                    edges.append((vertex[one[i]], vertex[two[j]]))
        linked_to = dict.fromkeys(np.flatnonzero(links).tolist())
        a = [int(e[0]) for e in edges] + [int(vertex[i]) for i in linked_to]
        b = [int(e[1]) for e in edges] + [None] * len(linked_to)
        n = [0] * len(edges) + [int(links[i]) for i in linked_to]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(n, pa.int64())})

    return compare


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text with fewer words than
    ``width`` is one n-gram; without words, or null, it has none and is linked with nothing.  component_id is
    the least doc_id that links reach, n_links the number of other rows that this row is linked with.
    Repeated rows are linked with each other; null ids are never a component's id unless it has no other.
    Other columns are not read.  Sets are compared by 64-bit n-gram hashes; two different sets are one
    vertex only if their own 64-bit hashes are equal, expected for fewer than one in 10^9 documents.
    """
    return _labelled(docs, width, percent, doc_id, text).select("doc_id", "n_shingles", "component_id", "n_links")


def _labelled(docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """:func:`ngram_join` with each row's SHA-256 of the text and the label of its component (null without n-grams)."""
    limit = Threshold(percent)
    texts = only(docs, doc_id=f"{doc_id} long", text=f"{text} string")
    schema = "unit long, n_keys long, keys binary, doc_ids array<long>, shas array<binary>, sizes array<long>, vertices array<long>, sets binary"
    units = written(texts.mapInArrow(_gather(width, limit), schema), "segments")
    rows = units.select(F.inline(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("shas").alias("sha"), F.col("sizes").alias("n_shingles"), F.col("vertices").alias("vertex"))))
    rows = written(rows.toDF("doc_id", "sha", "n_shingles", "vertex"), "rows")

    answered, owners = with_repeats(units)
    shared = answered.select("keys", "answers", "sets").mapInArrow(_shared(owners), "vertex long, size long, fragments long, segment long")
    shared = written(shared.distinct(), "shared")
    discard(units)
    often = shared.groupBy("segment").agg(F.count("*").alias("times")).where("times > 1").withColumnRenamed("segment", "_segment")
    held = shared.join(often, F.col("segment") == F.col("_segment")).drop("_segment")
    mine = Window.partitionBy("vertex", "fragments")
    differing = F.floor(F.col("size") * (100 - percent) / percent)
    # the segments nobody else has come first, then those of fewest sets
    place = F.row_number().over(mine.orderBy("times", "segment")) + F.col("fragments") - F.count("*").over(mine)
    prefix = written(held.withColumn("_place", place).where(F.col("_place") <= differing + 1).select("vertex", "segment"), "prefix")

    several = prefix.groupBy("segment").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("segment", "_segment")
    close = prefix.join(several, F.col("segment") == F.col("_segment"), "left_semi").select(F.col("vertex").alias("_vertex")).distinct()
    classes = written(rows.where("n_shingles > 0").groupBy("vertex").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    asked = classes.join(close, F.col("vertex") == F.col("_vertex"), "left_semi").select(F.col("least").alias("_id"), "vertex", "copies")
    bodies = texts.join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "vertex", "copies")
    units = written(bodies.mapInArrow(_sets_of(width), "unit long, n_keys long, vertices array<long>, copies array<long>, sizes array<long>, keys binary"), "sets")
    discard(shared, prefix)
    answered, owners = with_repeats(units)
    sets = answered.drop("unit", "n_keys").mapInArrow(_prefixes(limit, owners), "vertex long, copies long, grams binary, first array<long>")
    sets = written(sets.dropDuplicates(["vertex"]), "prefixes")  # a row may be there twice
    discard(units)

    held = sets.select("vertex", F.explode("first").alias("gram"))
    first = held.groupBy("gram").agg(F.min("vertex").alias("b"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("gram", "_gram")
    star = held.join(first, F.col("gram") == F.col("_gram")).where("vertex != b").select(F.col("vertex").alias("a"), "b")
    groups = components(star)
    sizes = groups.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("label", "_label")
    members = written(groups.join(sizes, F.col("label") == F.col("_label")).select(F.col("vertex").alias("_vertex"), "label", "blocks"), "members")
    block = F.pmod(F.xxhash64("vertex", F.lit("block")), F.col("blocks").cast("long")).cast("int")
    full = sets.join(members, F.col("vertex") == F.col("_vertex")).select("label", "blocks", block.alias("block"), "vertex", "copies", "grams")
    pairs = full.select("label", "block", "vertex", "copies", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "vertex", "copies", "grams",
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    found = written(pairs.groupBy("label", "i", "j").applyInArrow(_compare(limit), "a long, b long, links long"), "links")
    discard(sets)

    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("_a")).agg(F.sum("links").alias("links"))
    labelled = classes.join(joined.withColumnRenamed("vertex", "_vertex"), F.col("vertex") == F.col("_vertex"), "left").drop("_vertex")
    labelled = labelled.join(counts, F.col("vertex") == F.col("_a"), "left").withColumn("label", F.coalesce("label", "vertex"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "_label")
    known = labelled.join(least, F.col("label") == F.col("_label")).select(
        F.col("vertex").alias("_vertex"), "label", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = rows.join(known, (F.col("vertex") == F.col("_vertex")) & (F.col("n_shingles") > 0), "left")
    return out.select(
        "doc_id", "sha", "n_shingles", "label",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, with all its columns; rows without words all stay.

    The row with the least id stays, null ids come last; of different texts with that id the one with the
    least SHA-256, of repeated rows any one.
    """
    found = written(_labelled(docs, width, percent, doc_id, text).where("label IS NOT NULL").select("label", "doc_id", "sha"), "labelled")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sha")
    several = found.groupBy(F.col("label").alias("_label")).agg(F.min(row).alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    listed = found.join(several, F.col("label") == F.col("_label")).withColumn("_stays", row == F.col("_best"))
    # repeated rows cannot be told apart: where the row that stays has some, all are found and one is taken
    gone = listed.groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(F.max("_stays").alias("_twin"), F.count("*").alias("_copies"))
    gone = written(gone.where("NOT _twin OR _copies > 1").select("_id", "_sha", "_twin"), "gone")
    sha = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"), sha.alias("sha"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    out = rows.join(gone.hint("merge"), same, "left_anti").select("row.*")
    twins = gone.where("_twin")
    if twins.isEmpty():
        return out
    once = rows.join(twins.hint("merge"), same).dropDuplicates(["id", "sha"]).select("row.*")
    return out.unionByName(once)
