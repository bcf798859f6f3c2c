"""Token ids against ``tokenizers`` as it is, on texts that hold the string of an added token."""

from collections import defaultdict

import numpy as np

from llm import packing, token_counts
from llm.encoding import encoder, ids, vocabulary

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "  <|endoftext|>  ", "<|endoftext| >", "<|ENDOFTEXT|>", "none", "", None, "ä<|endoftext|>ö 😀"]


def test_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert want[0] == [64, 220, 50256, 275]
    enc = encoder(**vocabulary())
    assert {i: ids(enc, t).tolist() for i, t in enumerate(TEXTS)} == want
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_lengths(docs, **vocabulary()).collect()} == {i: len(w) for i, w in want.items()}
    found = defaultdict(list)
    for r in sorted(packing.pack(docs, **vocabulary()).collect(), key=lambda r: r["start"]):
        found[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert found == {i: [*w, packing.END] for i, w in want.items()}
