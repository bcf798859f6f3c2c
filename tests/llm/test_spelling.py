"""Spelling variants against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from llm import spelling
from llm.spelling import spelling_variants, trie_paths, variants, word_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, every):
    out = Counter()
    for ident, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    return Counter({w: n for w, n in out.items() if w})


def brute_variants(words, ratio=5):
    deleted = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            deleted[i, w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), ws in deleted.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def told(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_word_counts(odd, empty, spark, monkeypatch):
    more = spark.createDataFrame([(1, "Straße ×÷ naïve ÀÉ-éà x1y don't " * 50), (2, "ĀabcĀ Ünder×ed"), (None, "colour Colour")], "doc_id long, text string")
    monkeypatch.setattr("llm.spelling.STEP_BYTES", 64)
    for docs in (odd, more):
        for every in (None, 3):
            got = word_counts(docs, every)
            assert {r["word"]: r["n"] for r in got.collect()} == brute_counts(rows_of(docs), every)
    assert word_counts(empty).collect() == []


def test_variants_of_short_words(spark):
    """Every pattern of repeated letters, where one deletion is found at several places."""
    draw = np.random.default_rng(4)
    words = {"".join(draw.choice(list("abé"), int(draw.integers(1, 7)))): int(draw.integers(1, 400)) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert told(variants(df)) == brute_variants(words)
    assert told(variants(df, ratio=2)) == brute_variants(words, 2)


def test_spelling_variants(odd, empty, spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for docs, every in ((documents, 199), (documents, 11), (odd, 2)):
        words = {w: n for w, n in brute_counts(rows_of(docs), every).items() if len(w) >= 6 and n >= 5}
        assert told(spelling_variants(docs, every)) == brute_variants(words)
    assert spelling_variants(empty).collect() == []


def test_forms_lead_to_the_last(spark):
    words = {"abcdef": 1, "abcdeg": 5, "abcdhg": 25, "abcihg": 125, "abjihg": 625, "akjihg": 3125, "zzzzzz": 7}
    rows = {r["word"]: r["root"] for r in variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert rows == {w: "zzzzzz" if w == "zzzzzz" else "akjihg" for w in words}


def test_trie_numbers_prefixes(spark):
    """One number per prefix, whatever the ranges of the sorted words."""
    draw = np.random.default_rng(2)
    words = sorted({"".join(draw.choice(list("ab"), int(draw.integers(1, 12)))) for _ in range(300)} | {"é" * 3000, "é" * 2999 + "a"})
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            paths = trie_paths(spark.createDataFrame([(w,) for w in words], "word string")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        number = {}
        for r in paths:
            assert len(r["path"]) == len(r["word"]) + 1
            for i, node in enumerate(r["path"]):
                assert number.setdefault(r["word"][:i], node) == node
        assert sorted(number.values()) == list(range(len(number))) and len(paths) == len(words)


def test_long_runs_are_cut_between_words(monkeypatch):
    monkeypatch.setattr("llm.spelling.STEP_BYTES", 10)
    total = Counter()
    for part in spelling._runs("a" * 25 + " bc " * 7 + "d" * 11):
        total.update(part)
    assert total == {b"a" * 25: 1, b"bc": 7, b"d" * 11: 1}
