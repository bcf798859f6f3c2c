"""Exact dedup, n-gram join and suffix dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import grouping
from llm.exact_dedup import exact_duplicates, keep_first
from llm.exchange import golomb_decode, golomb_encode
from llm.ngram_join import keep_one, ngram_join
from llm.suffix_dedup import remove_repeats
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_ngrams(rows, width=3, percent=90):
    def grams(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(text)
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])

    sets = [grams(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter()
    for h in holders.values():
        for k, i in enumerate(h):
            for j in h[k + 1 :]:
                common[i, j] += 1
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return Counter((d, len(sets[i]), min(least[root(i)], default=None), links[i]) for i, (d, _) in enumerate(rows))


def brute_spans(rows, width=200):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found_spans(df, width=200):
    out = remove_repeats(df, width=width).collect()
    assert all(hashlib.sha256(r["kept_text"]).hexdigest() == r["kept_sha256"] for r in out)
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.mark.parametrize("keys", [[], [0], [2**64 - 1], [0, 1, 2**63, 2**64 - 1], list(range(5000)), [i * i * 977 for i in range(3000)]])
def test_golomb_round_trip(keys):
    keys = np.array(keys, dtype=np.uint64)
    assert (golomb_decode(golomb_encode(keys)) == keys).all()


def test_grouping_sorts_suffixes():
    draw = np.random.default_rng(1)
    for _ in range(400):
        x = np.append(draw.integers(1, draw.integers(2, 6), draw.integers(0, 40)), 0)
        assert grouping.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def brute_copies(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out, stayed = Counter(), set()
    for d, t in rows:
        ids = groups[t or ""]
        best = max((i for i in ids if i is not None), default=None)
        kept = d == best and (t or "") not in stayed
        if kept:
            stayed.add(t or "")
        out[d, best, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_exact_duplicates(odd, empty, documents):
    for docs in (odd, documents):
        got = exact_duplicates(docs)
        assert Counter(map(tuple, got.collect())) == brute_copies(rows_of(docs))
    assert exact_duplicates(empty).collect() == []


def test_keep_first_keeps_columns(odd, empty):
    got = keep_first(odd)
    assert got.columns == odd.columns
    texts = [r["text"] or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows_of(odd)})
    assert keep_first(empty).collect() == []


def found_components(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join(df).collect())


def test_ngram_join(odd, empty, documents):
    for docs in (odd, documents):
        assert found_components(docs) == brute_ngrams(rows_of(docs))
    assert ngram_join(empty).collect() == []


def test_ngram_join_near_the_threshold(spark, monkeypatch):
    """A dense group of variants of one text, cut into several blocks."""
    monkeypatch.setattr("llm.ngram_join.BLOCK", 16)
    draw = np.random.default_rng(5)
    rows = []
    for g, size in enumerate((9, 11, 40, 120, 300)):
        base = [f"w{g}_{i}" for i in range(size)]
        for k in range(60):
            words = list(base)
            for at in draw.integers(0, size, draw.integers(0, max(2, size // 25))):
                words[at] = f"x{draw.integers(0, 3)}_{k % 7}"
            if draw.random() < 0.3:
                words = words[: -int(draw.integers(1, max(2, size // 12)))]
            rows.append((len(rows), " ".join(words)))
    assert found_components(spark.createDataFrame(rows, "doc_id long, text string")) == brute_ngrams(rows)


def test_keep_one(odd):
    got = keep_one(odd)
    assert got.columns == odd.columns
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3, 4, 5, 6, 7, 9, None}


def test_remove_repeats(odd, empty, documents):
    small = odd.where("doc_id IS NULL OR doc_id != 7")
    assert found_spans(small) == brute_spans(rows_of(small))
    assert found_spans(documents) == brute_spans(rows_of(documents))
    assert remove_repeats(empty).collect() == []


@pytest.mark.parametrize("together", [1000, 3])
def test_remove_repeats_with_many_ends(spark, monkeypatch, together):
    """One passage between different neighbours, periodic texts, and repetition inside a text."""
    monkeypatch.setattr("llm.suffix_dedup.SORTED_TOGETHER", together)
    monkeypatch.setattr("llm.suffix_dedup.SORT_SYMBOLS", 300)
    draw = np.random.default_rng(3)
    noise = lambda n: "".join(draw.choice(list("abcdefgh "), n))
    passage, other = noise(500), noise(230)
    texts = [noise(int(draw.integers(0, 300))) + passage[int(draw.integers(0, 120)) :] + noise(int(draw.integers(0, 300))) for _ in range(40)]
    texts += ["ab" * 300, "abc" * 200, "a" * 199, "a" * 200, "a" * 201, other + other, other + "é" + other[:199], passage[:200], passage[:199], ""]
    rows = list(enumerate(texts))
    assert found_spans(spark.createDataFrame(rows, "doc_id long, text string")) == brute_spans(rows)
