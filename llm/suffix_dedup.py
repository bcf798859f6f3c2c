"""Removal of repeated byte strings by suffix sorting (operator 10).

A string of ``width`` bytes that starts at two places is to go at all of them.  Every such window has an
anchor, the ``ANCHOR`` bytes with the least hash in it; equal windows have equal anchors at equal offsets.
Windows next to each other mostly share their anchor and form one *context*.

1. Contexts whose anchor occurs nowhere else hold no repeated window (Golomb-coded exchange of anchor
   hashes).  Contexts that occur twice as a whole are repeated throughout.
2. What is left are the ends of repeated passages: different contexts around one anchor.  Their bytes are
   cut down to what lies around a repeated core, the core itself is one symbol, and the rest is suffix-sorted
   by linear grouping; equal windows are neighbours in that order.
3. An anchor with very many different contexts is split further, window by window.

Sorting and comparing is done on input bytes, so what is removed never hides another repetition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import Units, discard, written
from llm.exchange import KEYS_PER_UNIT, repeated_items, with_repeats
from llm.grouping import suffix_array
from llm.textbuf import RangeHash, Texts, mixed, slices_by_bytes

ANCHOR = 64
#: Window starts that share one core when contexts are cut down.
STEP = 18
#: Different contexts of one anchor that are sorted together; more are split by window.
SORTED_TOGETHER = 1000
#: Contexts that one sorting task gets.
CONTEXTS_PER_TASK = 4000
#: Symbols in one suffix sort; more are sorted in several, strings with one core never apart.
SORT_SYMBOLS = 1 << 18


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: block-wise running minima from both sides."""
    n = len(x)
    blocks = np.append(x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(backward[:m], forward[width - 1 : width - 1 + m])


def contexts(t: Texts, width: int) -> dict[str, np.ndarray]:
    """Contexts of all texts: text number, first and last window start in it, hashes of anchor and whole."""
    n = len(t.data)
    if n < width:
        empty = np.zeros(0, np.int64)
        return {"text": empty, "first": empty, "last": empty, "anchor": empty.astype(np.uint64), "whole": empty.astype(np.uint64)}
    h = t.hashes()
    at = np.arange(n - ANCHOR + 1)
    value = h.of(at, at + ANCHOR)
    least = sliding_minimum(value, width - ANCHOR + 1)
    count = np.maximum(np.diff(t.bounds) - width + 1, 0)  # windows of each text
    owner = np.repeat(np.arange(t.n), count)
    start = np.arange(len(owner)) + np.repeat(t.bounds[:-1] - (np.cumsum(count) - count), count)
    least = least[start]
    # the anchor is the leftmost least one: it changes with its hash, or when the window has passed it
    new = np.ones(len(start), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (value[start[:-1]] == least[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    first, last, text = start[head], start[tail], owner[head]
    whole = h.of(first, last + width)
    return {"text": text, "first": first - t.bounds[text], "last": last - t.bounds[text], "anchor": least[head], "whole": whole}


def _gather(width: int) -> Callable:
    schema = pa.schema([("unit", pa.int64()), ("n_keys", pa.int64()), ("keys", pa.binary()), ("ids", pa.list_(pa.int64())), ("prints", pa.list_(pa.int64())),
                        ("wholes", pa.binary()), ("places", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, prints, found = Units(), [], [], []

        def unit() -> pa.RecordBatch:
            # an anchor is the least of many hashes: mixed again, so that owners of equal key ranges get equal shares
            anchors = mixed(np.concatenate([f["anchor"] for f in found]))
            places = np.stack([np.concatenate([f[c] for f in found]) for c in ("text", "first", "last")], axis=1).astype("<u4")
            wholes = np.concatenate([f["whole"] for f in found])
            row = [number(), len(anchors), anchors.tobytes(), ids, prints, wholes.tobytes(), places.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        held = 0
        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                f = contexts(Texts(part.column("text")), width)
                used, f["text"] = np.unique(f["text"], return_inverse=True)
                f["text"] = f["text"] + len(ids)
                ids += part.column("doc_id").take(pa.array(used)).to_pylist()
                prints += part.column("print").take(pa.array(used)).to_pylist()
                found.append(f)
                held += len(f["anchor"])
                if held >= KEYS_PER_UNIT:
                    yield unit()
                    ids, prints, found, held = [], [], [], 0
        if held:
            yield unit()

    return gather


_CONTEXT = "anchor long, whole long, doc_id long, print long, first long, last long"


def _suspects(owners: int) -> Callable:
    names = [c.split()[0] for c in _CONTEXT.split(", ")]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                anchors = np.frombuffer(r["keys"], "<u8")
                wholes, places = np.frombuffer(r["wholes"], "<i8"), np.frombuffer(r["places"], "<u4").reshape(-1, 3).astype(np.int64)
                hit = np.flatnonzero(repeated_items(anchors, r["answers"], owners))
                ids, prints = pa.array(r["ids"], pa.int64()), pa.array(r["prints"], pa.int64())
                for k in range(0, len(hit), 100_000):
                    h = hit[k : k + 100_000]
                    text = pa.array(places[h, 0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchors[h].view(np.int64)), pa.array(wholes[h]), ids.take(text), prints.take(text),
                         pa.array(places[h, 1]), pa.array(places[h, 2])], names=names,
                    )

    return suspects


def _cut_out(width: int) -> Callable:
    """Bytes of the listed contexts of every document."""
    names = ["anchor", "doc_id", "print", "first", "alone", "many", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                rows: list[tuple] = []
                for doc_id, mark, text, listed in zip(*(part.column(c) for c in ("doc_id", "print", "text", "listed"))):
                    body = text.as_buffer()
                    for c in listed.as_py():
                        rows.append((c["anchor"], doc_id.as_py(), mark.as_py(), c["first"], c["alone"], c["many"], body[c["first"] : c["last"] + width].to_pybytes()))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    return np.frombuffer(b"".join(bodies), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


class Ends:
    """Parts of contexts around a repeated core.

    ``STEP`` neighbouring window starts, counted from the anchor, share the core: the ``width`` - ``STEP`` + 1
    bytes that all their windows have.  Windows whose core no other context has are not repeated.  For the
    others the core is one symbol, so a window of ``width`` bytes is a string of ``STEP`` symbols, and a part
    has at most 2 * ``STEP`` - 1 of them.
    """

    def __init__(self, bodies: list[bytes], width: int):
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        data, bounds = np.frombuffer(b"".join(bodies), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        h = RangeHash(data)
        # the anchor: leftmost least hash of ANCHOR bytes inside the first window of the context, as in contexts()
        at = np.empty(len(bodies), dtype=np.int64)
        for i in range(len(bodies)):
            begin = np.arange(bounds[i], bounds[i] + width - ANCHOR + 1)
            at[i] = int(np.argmin(h.of(begin, begin + ANCHOR)))
        last = sizes - width
        parts = []
        for q in range(-(-(width - ANCHOR + 1) // STEP)):
            core_from, core_to = at - q * STEP, at - (q + 1) * STEP + 1 + width
            lo, hi = np.maximum(core_to - width, 0), np.minimum(core_from, last)
            some = np.flatnonzero(lo <= hi)
            value = h.of(bounds[some] + core_from[some], bounds[some] + core_to[some])
            _, place, times = np.unique(value, return_inverse=True, return_counts=True)
            keep = some[times[place] > 1]
            parts.append(np.stack([keep, lo[keep], hi[keep], core_from[keep], core_to[keep]], axis=1))
        names: dict[bytes, int] = {}
        strings: dict[tuple, int] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # context, first and last window start, string
        self.core_of: list[int] = []  # per string
        times = []
        for i, lo, hi, f, t in np.concatenate(parts).tolist():
            body = bodies[i]
            core = names.setdefault(body[f:t], len(names))
            key = (core, body[lo:f], body[t : hi + width])
            k = strings.setdefault(key, len(strings))
            if k == len(times):
                times.append(0)
                self.core_of.append(core)
            times[k] += 1
            self.parts.append((i, lo, hi, k))
        self.strings, self.times = list(strings), times

    def sorted_batches(self) -> Iterator[list[int]]:
        """Strings to sort, those of one core together; a core with one string needs no sorting."""
        by_core = np.argsort(np.array(self.core_of, dtype=np.int64), kind="stable").tolist()
        batch: list[int] = []
        size = at = 0
        while at < len(by_core):
            core, to = self.core_of[by_core[at]], at
            while to < len(by_core) and self.core_of[by_core[to]] == core:
                to += 1
            if to - at > 1:
                batch += by_core[at:to]
                size += (to - at) * 2 * STEP
            if size > SORT_SYMBOLS:
                yield batch
                batch, size = [], 0
            at = to
        if batch:
            yield batch

    def repeated(self) -> dict[int, np.ndarray]:
        """Per sorted string: the places in it where a window starts that another start has too."""
        out = {}
        for batch in self.sorted_batches():
            for k, places in zip(batch, repeated_windows([self._symbols(k) for k in batch], STEP)):
                out[k] = places
        return out

    def _symbols(self, k: int) -> np.ndarray:
        core, left, right = self.strings[k]
        return np.concatenate([np.frombuffer(left, np.uint8), [256 + core], np.frombuffer(right, np.uint8)]).astype(np.int64)


def repeated_windows(strings: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For every string of symbols the starts of the windows that another start, in any of them, has too."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.ones(begin[-1] + 1, dtype=np.int64)  # 1 parts strings, 0 ends them
    for at, s in zip(begin, strings):
        symbols[at : at + len(s)] = s + 2
    symbols[-1] = 0
    order = np.array(suffix_array(symbols), dtype=np.int64)
    string = np.minimum(np.searchsorted(begin, order, side="right") - 1, len(strings) - 1)
    place = order - begin[string]
    inside = place + width <= sizes[string]
    order, string, place = order[inside], string[inside], place[inside]
    # equal windows are neighbours in the order
    windows = np.lib.stride_tricks.sliding_window_view(symbols, width)
    hit = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        same = _equal_neighbours(windows, order)
        hit[1:] |= same
        hit[:-1] |= same
    by = np.argsort(string[hit], kind="stable")
    return np.split(place[hit][by], np.searchsorted(string[hit][by], np.arange(1, len(strings))))


def _equal_neighbours(windows: np.ndarray, order: np.ndarray, step: int = 65536) -> np.ndarray:
    out = np.empty(len(order) - 1, dtype=bool)
    for k in range(0, len(out), step):
        one, two = order[k : min(k + step, len(out))], order[k + 1 : min(k + step, len(out)) + 1]
        out[k : k + step] = (windows[one] == windows[two]).all(axis=1)
    return out


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.unique(starts)
    new = np.concatenate([[True], np.diff(starts) > 1]) if len(starts) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1 if len(head) else head
    return starts[head], starts[tail]


_SPAN = "doc_id long, print long, begin long, finish long"


def _sort_task(width: int) -> Callable:
    """Repeated byte spans of the contexts of some anchors."""

    def run(part: pa.Table) -> pa.Table:
        columns = {c: part.column(c).to_pylist() for c in ("doc_id", "print", "first", "alone")}
        ends = Ends([b.as_py() for b in part.column("bytes")], width)
        places, rows = ends.repeated(), []
        for i, lo, hi, k in ends.parts:
            if columns["alone"][i]:
                base = columns["first"][i] + lo
                if ends.times[k] > 1:
                    rows.append((columns["doc_id"][i], columns["print"][i], base, base + hi - lo + width))
                elif k in places:
                    for a, b in zip(*_runs(places[k])):
                        rows.append((columns["doc_id"][i], columns["print"][i], base + int(a), base + int(b) + width))
        names = [c.split()[0] for c in _SPAN.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows) if rows else [[]] * 4)})

    return run


def _windows(width: int) -> Callable:
    """Every window of contexts by two hashes, for anchors with very many contexts."""
    names = ["anchor", "window", "doc_id", "print", "begin", "alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_by_bytes(batch, "bytes", 200_000):
                data, bounds = _joined([b.as_py() for b in part.column("bytes")])
                count = np.diff(bounds) - width + 1
                row = np.repeat(np.arange(len(count)), count)
                start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = bounds[row] + start
                value = RangeHash(data).of(begin, begin + width).view(np.int64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("anchor").take(take), pa.array(value), part.column("doc_id").take(take), part.column("print").take(take),
                     pa.array(start + np.asarray(part.column("first"))[row]), part.column("alone").take(take)], names=names,
                )

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the spans out of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_text", pa.binary()), ("kept_sha256", pa.string())])
    for batch in batches:
        for part in slices_by_bytes(batch, "text"):
            rows = []
            for doc_id, text, spans in zip(part.column("doc_id").to_pylist(), part.column("text"), part.column("spans").to_pylist()):
                body = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                kept, at, gone, n = [], 0, 0, 0
                reach = -1
                for s in sorted((s["begin"], s["finish"]) for s in spans or []):
                    if s[0] > reach:  # a new run
                        if reach > at:
                            gone += reach - at
                        n += 1
                        if reach >= 0:
                            at = reach
                        kept.append(body[at : s[0]])
                        at, reach = s[0], s[1]
                    else:
                        reach = max(reach, s[1])
                if reach > at:
                    gone += reach - at
                    at = reach
                kept.append(body[at:])
                rest = b"".join(kept)
                rows.append((doc_id, len(body), gone, n, rest, hashlib.sha256(rest).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repeated_spans(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, print, begin, finish of byte spans that cover all repeated windows of (doc_id, print, text binary)."""
    schema = "unit long, n_keys long, keys binary, ids array<long>, prints array<long>, wholes binary, places binary"
    units = written(texts.mapInArrow(_gather(width), schema), "contexts")
    answered, owners = with_repeats(units)
    found = written(answered.drop("unit", "n_keys").mapInArrow(_suspects(owners), _CONTEXT), "suspects")
    discard(units)

    place = F.struct("doc_id", "print", "first", "last")
    kinds = found.groupBy("anchor", "whole").agg(F.count("*").alias("times"), F.min(place).alias("one"))
    kinds = written(kinds, "kinds")
    twice = kinds.where("times > 1").select(F.col("anchor").alias("_a"), F.col("whole").alias("_w"))
    # a context that occurs as a whole elsewhere is repeated throughout
    full = found.join(twice, F.expr("anchor = _a AND whole = _w"), "left_semi").select("doc_id", "print", F.col("first").alias("begin"), (F.col("last") + width).alias("finish"))

    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("times").alias("least")).where("n > 1 AND least = 1")
    per_anchor = per_anchor.select(F.col("anchor").alias("_a"), (F.col("n") > SORTED_TOGETHER).alias("many"))
    ends = kinds.join(per_anchor, F.expr("anchor = _a")).select("anchor", "one.*", (F.col("times") == 1).alias("alone"), "many")
    listed = ends.groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(
        F.collect_list(F.struct("anchor", "first", "last", "alone", "many")).alias("listed")
    )
    bodies = texts.join(listed.hint("merge"), F.expr("print = _print AND doc_id <=> _id")).select("doc_id", "print", "text", "listed")
    cut = written(bodies.mapInArrow(_cut_out(width), "anchor long, doc_id long, print long, first long, alone boolean, many boolean, bytes binary"), "ends")
    n = cut.where("NOT many").count()
    task = F.pmod(F.xxhash64("anchor"), F.lit(max(24, -(-n // CONTEXTS_PER_TASK))))
    few = cut.where("NOT many").groupBy(task.alias("task")).applyInArrow(_sort_task(width), _SPAN)
    windows = cut.where("many").mapInArrow(_windows(width), "anchor long, window long, doc_id long, print long, begin long, alone boolean")
    often = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("_a"), F.col("window").alias("_w"))
    many = windows.join(often, F.expr("anchor = _a AND window = _w"), "left_semi").where("alone").select("doc_id", "print", "begin", (F.col("begin") + width).alias("finish"))
    return full.unionByName(few).unionByName(many)


def remove_repeats(docs: DataFrame, width: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_text (binary), kept_sha256.

    Null text is empty; a text shorter than ``width`` keeps all its bytes.  A string repeated inside one
    document goes as well, overlaps included.  Rows repeated with their id are documents of their own, so
    all their windows go.  Other columns are not read.  Contexts are told apart by 64-bit hashes of anchor
    and whole together.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    ident = F.col(f"`{doc_id}`").cast("long")
    texts = docs.select(ident.alias("doc_id"), F.xxhash64(ident, body).alias("print"), F.encode(body, "UTF-8").alias("text"))
    spans = written(repeated_spans(texts, width), "spans")
    listed = spans.groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(F.collect_set(F.struct("begin", "finish")).alias("spans"))
    joined = texts.join(listed.hint("merge"), F.expr("print = _print AND doc_id <=> _id"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string"
    )
