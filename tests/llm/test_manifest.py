"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from copresence.llm import manifest
from odd_rows import ODD, got

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def climb(tree, at, node, fan):
    """The root with another node at a place, and the siblings."""
    siblings = []
    for nodes in tree[:-1]:
        first = at - at % fan
        left, right = nodes[first:at], nodes[at + 1:first + fan]
        siblings += [*left, *right]
        node, at = sha(*left, node, *right), at // fan
    return node, siblings


def brute(rows, fan, every=7):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        crc = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        other = n + 1 if n is not None and crc % every == 0 else n
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n, text), leaf(doc_id, source, lang, other, text), doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([m[2] for m in sorted(groups[g], key=lambda m: m[:3])], fan) for g in order}
    over = levels([trees[g][-1][0] for g in order], fan) if order else []
    out = []
    for at, g in enumerate(order):
        for i, (_, _, h, claim, doc_id) in enumerate(sorted(groups[g], key=lambda m: m[:3])):
            sub, first = climb(trees[g], i, claim, fan)
            folded, second = climb(over, at, sub, fan)
            root = over[-1][0]
            out.append((doc_id, h, trees[g][-1][0], root, sha(*first, *second), folded, folded == root))
    return sorted(out, key=repr)


def spread(n):
    langs = [None, "", "-", "de", "é", "en", "zz"]
    return [(i * 13 % 997, f"text {i}" if i % 5 else None, langs[i % 11 % 7] if i % 3 else "en", f"s{i % 4}" if i % 6 else None) for i in range(n)]


@pytest.mark.parametrize("rows", [ODD, [(1, "x")], [(i, "same") for i in (7, 7, 7, None, None)], spread(300), []], ids=["odd", "one", "ties", "many", "empty"])
@pytest.mark.parametrize("fan, depth", [(2, 10), (2, 2), (3, 1)])
def test_equals_plain_tree(table, rows, fan, depth):
    docs = table(rows)
    made = manifest.manifest(docs, FIELDS, claims={"n_chars": manifest.tampered(F.col("n_chars"))}, fan=fan, depth=depth)
    want = brute([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()], fan)
    assert sorted(got(made.folded()), key=repr) == want


def test_proofs(table):
    """The returned siblings lead from a leaf to the root."""
    docs = table(spread(60))
    for r in manifest.manifest(docs, FIELDS, depth=3).folded(with_proof=True).collect():
        node = r["leaf"]
        for step in r["proof"]:
            node = sha(step["left"], node, step["right"])
        assert node == r["root"] == r["folded_root"] and r["verified"]
        assert r["proof_sha256"] == sha(*[s["left"] + s["right"] for s in r["proof"]])


def test_resumed_states():
    """A fold hashes the replacement and what stands right of it, from a state that holds the left."""
    nodes = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(23)]
    for fan in (2, 3, 5):
        block = manifest.Block(nodes, manifest.height(len(nodes), fan), fan)
        for i in range(len(nodes)):
            plain = levels([n.decode() for n in [*nodes[:i], b"f" * 64, *nodes[i + 1:]]], fan)[-1][0]
            assert block.fold(i, b"f" * 64).decode() == plain and block.fold(i, nodes[i]) == block.top


def test_wide_keys(spark):
    """Keys beyond 2**53 beside null ones stay exact; counts at the end of their range can be tampered with."""
    rows = [(2**62 + 1, 2**63 - 1), (None, 5), (2**62 + 3, None)]
    docs = spark.createDataFrame([(d, "t", "en", "s", n) for d, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = manifest.manifest(docs, FIELDS, claims={"n_chars": manifest.tampered(F.col("n_chars"), every=1)}).folded().collect()
    assert {(r["doc_id"], r["verified"]) for r in out} == {(2**62 + 1, False), (None, True), (2**62 + 3, True)}
