"""The corpus pipeline, stage by stage, against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import mixing, quality
from llm.common import written
from llm.queries import quality_weights
from tests.conftest import SF_DIR
from tests.llm.test_pairs import brute_ngrams, rows_of


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, SF_DIR), name)
    return [*out, docs]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality_stage(stages):
    good = {r["doc_id"] for r in quality.quality(stages[0]).where("kept").collect()}
    assert {d for d, _ in rows_of(stages[1])} == good and 0 < len(good) < stages[0].count()


def test_exact_stage(stages):
    best = {}
    for d, t in rows_of(stages[1]):
        best[t] = max(d, best.get(t, d))
    assert sorted(rows_of(stages[2])) == sorted((d, t) for t, d in best.items())


def test_near_stage(stages):
    rows = rows_of(stages[2])
    want = {d for d, _, component, _ in brute_ngrams(rows, 5, 80) if d == component}
    assert {d for d, _ in rows_of(stages[3])} == want


def test_mix_stage(spark, stages):
    weighted = quality_weights(stages[3], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    times = {r["doc_id"]: r["epochs_taken"] for r in mixing.mix(weighted, F.col("_weight")).collect()}
    assert Counter(d for d, _ in rows_of(stages[4])) == +Counter(times)


def test_packing_stage(stages):
    copies = Counter(d for d, _ in rows_of(stages[4]))
    tokens, pieces = defaultdict(int), Counter()
    for r in stages[5].collect():
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
        pieces[r["sequence_id"]] += r["length"]
    assert {d: n * copies[d] for d, n in tokens} == {d: t for (d, _), t in tokens.items()}
    assert max(pieces.values()) <= 1024


def test_stages_take_odd_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF_DIR), name)
        docs.collect()


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR)
    key = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.where("start = 0").collect())
    assert key(got) == key(stages[5])
