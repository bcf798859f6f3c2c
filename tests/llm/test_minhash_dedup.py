"""MinHash near-duplicates against all pairs."""

from collections import Counter

import numpy as np
import pyarrow as pa

from llm.minhash_dedup import near_duplicates, table_keys
from llm.ngram_join import Shingles, ngram_join
from llm.quality import verdicts
from tests.conftest import SF_DIR
from tests.llm.test_pairs import brute_ngrams, rows_of


def found(df, **options):
    rows = near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def wanted(rows, width=4, percent=80):
    out = Counter()
    for (doc_id, size, component, _), n in brute_ngrams(rows, width, percent).items():
        out[doc_id, size, component] += n
    return out


def test_near_duplicates(odd, empty, spark):
    for docs in (odd, spark.read.parquet(f"{SF_DIR}/documents.parquet")):
        assert found(docs) == wanted(rows_of(docs))
    assert near_duplicates(empty).collect() == []


def variants_of_texts(draw):
    """Dense groups around a base, chains of neighbours, and one passage in many texts."""
    rows = []
    for g, size in enumerate((9, 14, 60, 200)):
        base = [f"w{g}_{i}" for i in range(size)]
        for k in range(70):
            words = list(base)
            for at in draw.integers(0, size, draw.integers(0, max(2, size // 20))):
                words[at] = f"x{draw.integers(0, 3)}_{k % 9}"
            rows.append(" ".join(words))
    chain = [f"c{i}" for i in range(300)]
    rows += [" ".join(chain[3 * k : 3 * k + 100]) for k in range(60)]
    passage = [f"p{i}" for i in range(80)]
    rows += [" ".join(passage + [f"own{k}_{i}" for i in range(int(draw.integers(5, 80)))]) for k in range(80)]
    return list(enumerate(rows))


def test_groups_chains_and_passages(spark):
    rows = variants_of_texts(np.random.default_rng(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(docs) == wanted(rows)


def test_few_tables_still_settle_groups_exactly(spark):
    """What the hubs leave open is settled on full sets, so fewer tables lose little inside a group."""
    rows = [(k, " ".join(f"w{i}" if i % 60 != k else f"x{k}_{i}" for i in range(120))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, tables=6) == wanted(rows)


def test_table_keys_agree_as_their_halves_do():
    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w7 ", "x7 ")
    s = Shingles(pa.array([text, near, text, "a b c d e f"]), 4)
    keys = table_keys(s, np.arange(4), tables=5, rows=2)
    assert keys.shape == (4, 25) and (keys[0] == keys[2]).all() and not (keys[0] == keys[3]).any()
    same = (keys[0] == keys[1]).reshape(5, 5)
    assert (same == np.outer(same.any(axis=1), same.any(axis=0))).all() and same.any()


def thue_morse(a, b, n=1024):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n)), "".join(a if bin(i).count("1") % 2 else b for i in range(n))


def test_strings_of_regular_build_stay_apart(spark):
    """Hashes that are polynomials modulo 2**64 cannot tell these apart."""
    q, r = thue_morse("q", "r")
    docs = spark.createDataFrame([(1, q), (2, r), (3, f"a {q} {r} s b {q} {r} s")], "doc_id long, text string")
    for join in (ngram_join(docs, 3, 90), near_duplicates(docs, 3, 90)):
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in join.collect()} == {1: (1, 1), 2: (1, 2), 3: (5, 3)}
    swapped = spark.createDataFrame([(1, f"a {q} s b {r} s a {q} c")], "doc_id long, text string")
    assert ngram_join(swapped, 3, 90).first()["n_shingles"] == 7
    counts = verdicts(pa.array([f"{q}\n{r}\n{q}", f"a {q} s b a {r} s"]))
    assert counts["n_dup_lines"].tolist() == [1, 0] and counts["n_repeat_words"].tolist() == [0, 0]
