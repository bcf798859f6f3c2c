"""Mentions at sentence ends, in JSON and with punctuation inside."""

import json
import re

from pyspark.sql import functions as F

from llm import pii

DOCS = [
    (1, "write to ada@example.com. Then wait"),
    (2, "ask ada@example.com, or (bob@mail.example.org). Or eve@example.co.uk!"),
    (3, "a@" + "b." * 126 + "com. Long"),
    (4, '{"password": "Tr0ub4dor&3secret", "user": "bob", "api_key":"k\\"ey,with quote"}'),
    (5, "password=Tr0ub4dor&3secret. Next, 'token' : 'correct horse battery' and secret: Gehäuse§größe, done"),
    (6, "Password: ________ and token: -------- stay, so does \"token\":\"abc\",\"user\":\"somebody\""),
    (7, 'token="never(closed)2day and more'),
    (8, "password=$$$$!!!!##%%"),
    (9, "a@" + "b." * 30_000 + "com: more labels than a domain has"),
]


def test_mentions_are_found_whole(spark):
    rows = pii.pseudonymise(spark.createDataFrame(DOCS, "doc_id long, text string"), "k").collect()
    got, n = {r["doc_id"]: r["text"] for r in rows}, {r["doc_id"]: r["n_entities"] for r in rows}
    assert n == {1: 1, 2: 3, 3: 1, 4: 2, 5: 3, 6: 0, 7: 1, 8: 1, 9: 0}
    gone = ("ada@", "bob@", "eve@", "co.uk", "b.b.b", "Tr0ub", "&3secret", "with quote", "ey,", "horse", "battery", "Gehäuse", "größe", "never", "closed", "2day", "$$$$", "##%%")
    for s in gone:
        assert not any(s in t for d, t in got.items() if d != 9), s
    made = got[1].split()[2]
    assert got[1] == f"write to {made} Then wait" and made.endswith(".") and made[:-1] in got[2] and got[2].endswith("!")
    assert json.loads(got[4])["user"] == "bob" and set(json.loads(got[4])) == {"password", "user", "api_key"}
    password = json.loads(got[4])["password"]
    assert got[5].startswith(f"password={password}. Next, 'token' : '") and got[5].endswith(", done")
    assert got[6] == dict(DOCS)[6] and got[7].endswith(" and more")


def against_real(spark, mentions, form, copies=2):
    """Every mention stands in ``copies`` documents: one surrogate each, none shared, none of them real."""
    rows = [(c * len(mentions) + i, f"see {m} here") for c in range(copies) for i, m in enumerate(mentions)]
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert len(got) == len(rows)
    made = [got[i][len("see ") : -len(" here")] for i in range(len(mentions))]
    for i in range(len(rows)):
        assert got[i] == f"see {made[i % len(mentions)]} here"
    assert len(set(made)) == len(mentions) and not set(made) & set(mentions)
    assert all(re.fullmatch(form, m) for m in made), made[:20]
    return made


def test_more_entities_than_surrogates_of_their_format(spark):
    """Redraws end: where a format is used up, surrogates grow."""
    made = against_real(spark, [f'password="-------{i}"' for i in range(10)], r'password="-------\d{2,}"')
    assert max(map(len, made)) <= len('password="-------0"') + 6
    made = against_real(spark, [f"+{i}" for i in range(1000, 7000)], r"\+\d{4,}", 1)
    assert max(map(len, made)) <= 9


def test_growth_keeps_each_format(spark):
    """Draws far beyond the first, kind by kind, still read as the kind and stay distinct."""
    norms = {
        "email": ("a@x.com", r"[a-z]{7}@[a-z]{6}\.example\.(com|org|net)"), "cloud_key": ("AKIA" + "0" * 16, r"AKIA\d{16}[A-P]{6}"), "secret": ("12345678", r"\d{14}"),
        "phone": ("1000", r"[2-9]\d{9}"), "national_id": ("123456789", r"9\d{14}"), "iban": ("DE89370400440532013000", r"DE\d{26}"),
        "ip": ("1.2.3.4", r"\d+(\.\d+){4}"), "surname_latin": ("stone", r"[a-z]{14}"), "given_f_cyrillic": ("анна", r"[а-я]{14}а"),
    }
    rows = spark.createDataFrame([(k, n) for k, (n, _) in norms.items()] + [("card", "4111111111111111")], "kind string, norm string")
    fakes = {a: {r["kind"]: r["fake"] for r in rows.select("kind", pii.surrogate(rows.kind, rows.norm, F.lit(a), "k").alias("fake")).collect()} for a in range(pii.PLAIN_DRAWS + 6)}
    last = fakes[pii.PLAIN_DRAWS + 5]
    for kind, (_, form) in norms.items():
        assert re.fullmatch(form, last[kind]), (kind, last[kind])
    for a in range(pii.PLAIN_DRAWS, pii.PLAIN_DRAWS + 6):
        digits = [int(c) for c in fakes[a]["card"]]
        assert len(digits) == 16 + a - pii.PLAIN_DRAWS + 1
        assert sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    for kind in last:
        assert len({fakes[a][kind] for a in fakes}) == len(fakes)
