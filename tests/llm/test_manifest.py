"""The Merkle manifest against a plain tree."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from llm import manifest
from llm.manifest import document_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, **other):
    values = [{**row, **other}[f] for f in FIELDS]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grown(nodes):
    """Root, and per node its (side, sibling) steps; a lone node has (None, None)."""
    steps, level = [[] for _ in nodes], [(n, [i]) for i, n in enumerate(nodes)]
    while len(level) > 1:
        following = []
        for k in range(0, len(level), 2):
            pair = level[k : k + 2]
            if len(pair) == 1:
                for i in pair[0][1]:
                    steps[i].append((None, None))
                following.append((H(pair[0][0]), pair[0][1]))
            else:
                (a, of_a), (b, of_b) = pair
                for i in of_a:
                    steps[i].append(("R", b))
                for i in of_b:
                    steps[i].append(("L", a))
                following.append((H(a, b), of_a + of_b))
        level = following
    return level[0][0], steps


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        found = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[lang] = (found, *grown([leaf_of(r) for r in found]))
    root, upper = grown([trees[lang][1] for lang in langs]) if langs else (None, [])
    out = Counter()
    for lang, more in zip(langs, upper):
        found, subroot, steps = trees[lang]
        for r, own in zip(found, steps):
            path = own + more
            hit = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf_of(r, n_chars=r["n_chars"] + 1) if hit else leaf_of(r)
            for side, sibling in path:
                node = H(node) if side is None else H(node, sibling) if side == "R" else H(sibling, node)
            proof = H(*[s for side, s in path if side])
            out[r["doc_id"], leaf_of(r), subroot, root, proof, node, node == root] += 1
    return out


def result(df, **options):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(tuple(r[n] for n in names) for r in document_manifest(df, **options).collect())


def rows_of(df):
    return [r.asDict() for r in df.select(*FIELDS).collect()]


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_equals_plain_tree(odd, spark, height):
    assert result(odd, height=height) == brute(rows_of(odd))
    rows = [(i, f"text {i}", ("en", "de", None, "fr")[min(i % 7, 3)], "s", None if i % 5 == 0 else i) for i in range(61)]
    docs = spark.createDataFrame([*rows, (2**62, "x", "Z", None, 2**63 - 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert result(docs, height=height) == brute(rows_of(docs))


def test_one_leaf_and_none(odd, empty):
    one = odd.where("doc_id = 9")
    found = result(one)
    assert found == brute(rows_of(one))
    (_, leaf, subroot, root, *_), = found
    assert leaf == subroot == root
    assert document_manifest(empty).collect() == []


def test_tampering_is_found(odd):
    for row in document_manifest(odd, tampered_every=1).collect():
        assert row["verified"] == (row["doc_id"] is None or row["doc_id"] == 2)  # null ids and null n_chars stay


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31])
def test_witnesses_grow_with_appends(n):
    tree = manifest.Frontier()
    leaves = [H(str(i)) for i in range(n)]
    for leaf in leaves:
        tree.append(leaf)
    root = tree.close((n - 1).bit_length())
    want, steps = grown(leaves)
    assert root == want
    assert tree.witnesses == [["." if side is None else side + sibling for side, sibling in s] for s in steps]
