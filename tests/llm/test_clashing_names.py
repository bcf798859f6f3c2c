"""Columns of the user's that have the names used inside, with values of their own."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.encoding import encoder, ids, vocabulary
from llm.exact_dedup import keep_first
from llm.mixing import mixed_documents
from llm.ngram_join import keep_one
from llm.packing import pack
from llm.token_counts import token_lengths

NAMES = (
    "_id _sha _twin id sha row mine at _quality _of _time _words _weight words weight _source source_size key size _at _part _epochs _last label vertex unit place"
).split()


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i % 40, f"text number {i % 25} with some more words in it", "en", f"s{i % 3}", 5) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[(F.monotonically_increasing_id() + k).alias(n) for k, n in enumerate(NAMES)])


def test_rows_keep_their_columns(spark, named):
    every = Counter(map(tuple, named.collect()))
    for kept in (keep_first(named), keep_one(named), mixed_documents(named), corpus_pipeline.source_mix(spark, named, "/root/testdata/sf0.001")):
        assert kept.columns == named.columns
        assert set(map(tuple, kept.collect())) <= set(every)
    assert len(keep_first(named).collect()) == 25


def test_repeated_rows_with_other_values_are_one(spark):
    docs = spark.createDataFrame([(1, "a b c d", f"{k}") for k in range(3)], "doc_id long, text string, _id string").withColumn("_sha", F.col("_id"))
    assert keep_first(docs).count() == 1 and keep_one(docs).count() == 1


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_long_white_space(spark, blank):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "start" + blank * 1_000_000 + "end <|endoftext|> of it"
    want = plain.encode(text, add_special_tokens=False).ids
    assert ids(encoder(**vocabulary()), text).tolist() == want
    short = "a" + blank * 99_000 + "b"
    assert ids(encoder(**vocabulary()), short).tolist() == plain.encode(short, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_lengths(docs, **vocabulary()).collect()}[1] == len(want)
    pieces = sorted((r["start"], r["ids"]) for r in pack(docs, **vocabulary()).where("doc_id = 1").collect())
    assert np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist() == [*want, 0]
