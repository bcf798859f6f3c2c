"""Spelling variants by pairs of trie nodes (operator 13).

Words are sorted and streamed, which numbers the nodes of their trie: a word takes over the path of the one before
it as far as both agree and adds nodes for the rest.  The reversed words give a second trie.  A word with position i
skipped is the pair (node of its prefix of i, node of its suffix after i); the same pair at an inserted position is
(node of the prefix of i, node of the suffix from i).  So words meet on pairs of integers, exactly:

* two words with one pair at skipped positions differ by one replaced code point;
* a skipped position that meets an inserted one makes the first word the second with a code point more.

Of equal neighbouring code points only the first counts as skipped for an insertion, so each relation is met once.
A pair fixes all but one code point of a word, so it has one member per letter of the alphabet, and one more.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from llm.common import only, written

#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Bytes of text that are cut into runs at once.
STEP_BYTES = 4_000_000

#: Of ISO 8859-1, where a letter is one byte: A-Z to a-z, other letters as they are, the rest to blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _runs(text: str) -> Iterator[Counter]:
    """Runs of letters of a text in ISO 8859-1, counted in steps that end between runs."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        end = min(len(data), at + STEP_BYTES)
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            cut = data.find(b" ", end) if cut <= at else cut
            end = len(data) if cut < 0 else cut
        yield Counter(data[at:end].split())
        at = end


def _spoilt(run: bytes, seed: int, every: int) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, spoil_every: int | None = None, least_length: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of A-Z, a-z and U+00C0 to U+00FF in all texts, A-Z lower-cased, with their number.

    Where ``spoil_every`` divides h, the CRC-32 of ``<doc_id>:<run>`` (nothing stands for a null id), the run loses its
    code point h % length.  Words below ``least_length`` code points are left out.  Null and empty texts have no
    words, repeated rows count each time, other columns are not read.  Tasks count before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for ident, body in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                seed = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                for found in _runs(body.as_py() or ""):
                    for run, n in found.items():
                        if len(run) < least_length:
                            continue
                        word = _spoilt(run, seed, spoil_every) if spoil_every else run
                        if len(word) >= max(least_length, 1):
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held = Counter()
        if held:
            yield rows()

    counted = only(docs, doc_id=f"{doc_id} long", text=f"{text} string").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of every word through the trie of this task's sorted words; nodes are numbered as they come up."""
    part, before, path, following = TaskContext.get().partitionId(), "", [0], 1
    for batch in batches:
        paths = []
        for word in batch.column("word").to_pylist():
            kept = _shared(before, word)
            fresh = len(word) - kept
            path = path[: kept + 1] + list(range(following, following + fresh))
            before, following = word, following + fresh
            paths.append(path)
        columns = [batch.column("word"), pa.array([part] * len(batch), pa.int32()), pa.array(paths, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "part", "path"])


def trie_paths(words: DataFrame) -> DataFrame:
    """(word, path) for distinct words: the numbers of the trie nodes of its prefixes, the empty one first.

    Tasks walk ranges of the sorted words.  The first word of a range may go on from the last one of the ranges before:
    one row per range, on the driver, tells which of its nodes are known already and where the new ones start.
    """
    sorted_words = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    walked = written(sorted_words.mapInArrow(_walk, "word string, part int, path array<long>"), "trie")
    ends = walked.groupBy("part").agg(
        F.min(F.struct("word", "path")).alias("first"), F.max(F.struct("word", "path")).alias("last"), F.max(F.array_max("path")).alias("top")
    )
    rows, before, known, start = [], "", [0], 1
    for end in sorted(ends.collect(), key=lambda r: r["part"]):
        alias = known[: _shared(before, end["first"]["word"]) + 1]  # local numbers 0, 1, ... are the first word's path
        shift = start - len(alias)
        rows.append((end["part"], alias, shift))
        before, known = end["last"]["word"], [alias[x] if x < len(alias) else x + shift for x in end["last"]["path"]]
        start = end["top"] + shift + 1
    parts = words.sparkSession.createDataFrame(rows, "_part int, alias array<long>, shift long")
    number = F.transform("path", lambda x: F.when(x < F.size("alias"), F.get("alias", x.cast("int"))).otherwise(x + F.col("shift")))
    return walked.join(parts, F.col("part") == F.col("_part")).select("word", number.alias("path"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for words (word, n) that differ from others by one inserted, deleted or replaced code point.

    ``best`` is the near word of largest n as (minus its n, word), the first by code point on ties.
    """
    prefix = trie_paths(words).withColumnRenamed("path", "prefix")
    suffix = trie_paths(words.select(F.reverse("word").alias("word")))
    suffix = suffix.select(F.reverse("word").alias("_word"), F.col("path").alias("suffix"))
    both = words.join(prefix.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w")).join(suffix, F.col("word") == F.col("_word"))
    size, at = F.length("word"), lambda c, i: F.get(c, i.cast("int"))
    char = lambda i: F.substring("word", i.cast("int") + 1, F.lit(1))
    skipped = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(at("prefix", i).alias("p"), at("suffix", size - 1 - i).alias("s"), F.lit(True).alias("skip"), ((i == 0) | (char(i) != char(i - 1))).alias("once")),
    )
    inserted = F.transform(
        F.sequence(F.lit(0), size), lambda i: F.struct(at("prefix", i).alias("p"), at("suffix", size - i).alias("s"), F.lit(False).alias("skip"), F.lit(True).alias("once"))
    )
    entries = both.select("word", (-F.col("n")).alias("m"), F.explode(F.concat(skipped, inserted)).alias("e"))
    member = F.struct("m", "word", F.col("e.skip").alias("skip"), F.col("e.once").alias("once"))
    groups = entries.groupBy("e.p", "e.s").agg(F.array_sort(F.collect_list(member)).alias("of")).where("size(of) > 1")
    rank = lambda x: F.struct(x["m"].alias("m"), x["word"].alias("word"))
    groups = groups.select(
        F.filter("of", lambda x: x["skip"]).alias("skips"), F.get(F.filter("of", lambda x: ~x["skip"]), F.lit(0)).alias("whole")
    )
    longer = F.filter("skips", lambda x: x["once"])
    first, second = F.get("skips", F.lit(0)), F.get("skips", F.lit(1))

    def of_skip(x):
        other = F.when(x["word"] == first["word"], second).otherwise(first)
        whole = F.when(x["once"], F.col("whole"))
        best = F.least(F.when(other.isNotNull(), rank(other)), F.when(whole.isNotNull(), rank(whole)))
        return F.struct(x["word"].alias("word"), (F.size("skips") - 1 + whole.isNotNull().cast("int")).alias("near"), best.alias("best"))

    of_whole = F.struct(F.col("whole.word").alias("word"), F.size(longer).alias("near"), F.when(F.size(longer) > 0, rank(F.get(longer, F.lit(0)))).alias("best"))
    told = groups.select(F.explode(F.concat(F.transform("skips", of_skip), F.when(F.col("whole").isNotNull(), F.array(of_whole)).otherwise(F.array()))).alias("t"))
    return told.where("t.near > 0").groupBy("t.word").agg(F.sum("t.near").alias("n_near"), F.min("t.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far each round.

    A form has several times the count of its word, so there are no circles and few rounds.
    """
    state = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = written(state.join(ahead, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per word of (word, n): word, n, n_near, form, form_n, root.

    Near words differ by exactly one inserted, deleted or replaced code point; ``n_near`` is their number.  ``form`` is
    the near word of largest n (ties: first by code point) if that is at least ``ratio`` times the word's n, else null;
    ``root`` is where forms lead, the word itself if it has none.  Words have to be distinct and not null; ``ratio``
    is above 1.  An empty table gives no rows.
    """
    near = near_words(words).withColumnRenamed("word", "_near")
    told = words.join(near, F.col("word") == F.col("_near"), "left")
    has = (-F.col("best.m")) >= ratio * F.col("n")
    told = written(
        told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "near"
    )
    roots = _roots(told.where("form IS NOT NULL")).withColumnsRenamed({"word": "_word", "root": "_root"})
    out = told.join(roots, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, spoil_every: int | None = None, least_length: int = 6, least_n: int = 5, ratio: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`variants` of the words of ``docs`` with ``least_length`` code points and ``least_n`` occurrences or more."""
    words = word_counts(docs, spoil_every, least_length, doc_id, text).where(F.col("n") >= least_n)
    return variants(written(words, "words"), ratio)
