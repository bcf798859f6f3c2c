import pytest

ODD_DOCS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 10),
    (1, "one two three four five six seven eight nine ten", "en", "a", 10),  # repeated row
    (2, None, None, None, None),
    (None, "one two three four five six seven eight nine ten", "en", None, 1),
    (None, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, "   \n\t ", "en", "b", 5),
    (5, "ÄÖ äö €uro 😀 word\n" * 40, "de", "b", 1),
    (6, "x" * 70_000, "en", "a", 70_000),
    (7, "long words here and there " * 9_000, "en", "a", 1),
    (8, "One TWO three four five six seven eight nine ten", "en", "b", 1),
    (9, "\u0001a\u0002b back\\slash </s> [INST]", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use inside."""
    docs = spark.createDataFrame(ODD_DOCS, SCHEMA)
    extra = ("kept", "keep_id", "size", "label", "vertex", "_id", "unit", "key", "print", "spans", "_source", "component_id", "times")
    return docs.selectExpr("*", *[f"'clash' AS {c}" for c in extra])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
