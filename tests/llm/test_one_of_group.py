"""Near copies: exactly one row of each component stays, whatever the ids."""

from collections import Counter

from llm.ngram_join import keep_one

WORDS = [f"w{i}" for i in range(40)]


def text(name, change=""):
    return " ".join([f"{name}{w}" for w in WORDS] + ([change] if change else []))


def test_one_row_of_each_component(spark):
    rows = [
        (1, text("a")), (5, text("a", "x")), (5, text("b")),  # an id with a copy and a text of its own
        (3, text("c")), (3, text("d", "y")), (2, text("c", "z")), (9, text("d")),  # an id that leads one group and follows in another
        (None, text("e")), (7, text("e", "x")), (None, text("e", "y")),  # null ids beside an id
        (None, text("f")), (None, text("f", "x")), (None, text("f")),  # null ids alone
        (4, text("g")), (4, text("g")), (4, text("G")),  # repeated rows, and the same n-grams in another text
        (8, None), (8, None), (None, ""),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, _twin string")
    got = keep_one(docs)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert not kept - Counter(rows)
    groups = Counter((t or " ")[0].lower() for _, t in kept.elements())
    assert groups == {**dict.fromkeys("abcdefg", 1), " ": 3}
    ids = {t[0].lower(): d for d, t in kept if t}
    assert ids == {"a": 1, "b": 5, "c": 2, "d": 3, "e": 7, "f": None, "g": 4}
