"""Exact, SimHash and embedding dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from copresence.llm import common, embed_dedup, exact_dedup, simhash
from odd_rows import ODD, got


def united(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(100, i) for i in range(50)],
    [(i, (7 * i + 3) % 97) for i in range(0, 97, 2)], [(-5, 3), (3, -9), (2**62, -(2**62))],
])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    links = [p for p in links if p[0] != p[1]]
    want = united({n for p in links for n in p}, links)
    assert dict(got(common.components(df))) == want


# ---------------------------------------------------------------- exact

def exact_brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        text = text or ""
        key = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text).encode()).hexdigest()
        groups[key].append((-len(text), doc_id is None, doc_id or 0, doc_id))
    return sorted(
        ((r[3], min(g)[3], len(g), key) for key, g in groups.items() for r in g), key=repr)


@pytest.mark.parametrize("support", [0.5, 0.1, 0.001])
def test_exact_groups(odd, table, support):
    rnd = random.Random(3)
    rows = ODD + [(100 + i, rnd.choice(["hot text", "hot  text", "hottext", "b" * rnd.randint(1, 4), f"cold {i}"])) for i in range(300)]
    out = got(exact_dedup.exact_groups(table(rows), support=support))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in out), key=repr) == exact_brute(rows)
    kept = [r for r in out if r[3]]
    assert len(kept) == len({r[4] for r in out}) and all(r[0] == r[1] for r in kept)


def test_exact_keep_first(odd, table):
    kept = got(exact_dedup.keep_first(odd))
    assert len(kept) == len({k for *_, k in exact_brute(ODD)})
    assert sorted(r[0] for r in kept if r[0] is not None) == [3, 4, 5, 6, 8, 9, 10, 11] or len(kept) == 8
    assert odd.columns == exact_dedup.keep_first(odd).columns
    assert got(exact_dedup.keep_first(table([]))) == [] and got(exact_dedup.exact_groups(table([]))) == []


# ---------------------------------------------------------------- simhash

def print_brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(rows, bits=2):
    prints = [print_brute(t) for _, t in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if (a ^ b).bit_count() <= bits]
    root = united(distinct, links)
    low = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            low[root[p]] = min(low.get(root[p], doc_id), doc_id)
    return sorted(((d, f"{p:016x}", low.get(root[p])) for (d, _), p in zip(rows, prints)), key=repr)


def near_copies(rnd, n):
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(160)]
    for i in range(n):
        copy = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        yield " ".join(copy)


@pytest.mark.parametrize("longest", [1, 3, 64])
def test_simhash_groups(table, longest):
    rnd = random.Random(5)
    rows = ODD + [(100 + i, t) for i, t in enumerate(near_copies(rnd, 60))] + [(300 + i, t.upper()) for i, t in enumerate(near_copies(rnd, 30))]
    out = got(simhash.near_groups(table(rows), longest=longest))
    assert sorted((r[:3] for r in out), key=repr) == groups_brute(rows)
    assert all(r[4] == (r[2] is None or r[0] == r[2]) for r in out)


@pytest.mark.parametrize("longest", [1, 4, 1000])
def test_simhash_links(spark, longest):
    """Fingerprints around a few centres, so that lists of every length occur."""
    rnd = random.Random(longest)
    prints = set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(60):
            value = centre
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                value ^= 1 << b
            prints.add(value)
    prints = [simhash._signed(p) for p in prints]
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    found = got(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), longest=longest))
    assert {frozenset(p) for p in found} <= {frozenset(p) for p in links}
    assert united(prints, found) == united(prints, links)
    if longest == 1000:
        assert {frozenset(p) for p in found} == {frozenset(p) for p in links}


def test_simhash_keep_first(odd, table):
    kept = simhash.keep_first(odd)
    want = {d for d, _, c in groups_brute(ODD) if d == c}
    assert {r[0] for r in got(kept)} == want and kept.columns == odd.columns
    assert got(simhash.near_groups(table([]))) == []
    assert simhash.fingerprint("a b c d" * 100_000) % 2**64 == print_brute("a b c d" * 100_000)


# ---------------------------------------------------------------- embeddings

def vectors(rnd, n, dim=16):
    out = []
    for label in (1, 2, 3):
        centres = rnd.normal(size=(n // 12, dim))
        for i in range(n):
            v = centres[rnd.integers(len(centres))] + rnd.normal(size=dim) * rnd.choice([0.05, 0.2, 0.3]) if i % 2 else rnd.normal(size=dim)
            out.append((v.astype(np.float32).tolist(), label))
    tight = rnd.normal(size=dim)
    out += [((tight + rnd.normal(size=dim) * 0.02).astype(np.float32).tolist(), 1) for _ in range(2 * n)]
    out += [out[3]] * 5 + [([2 * x for x in out[4][0]], out[4][1])]
    out += [(None, 1), ([], 1), ([0.0] * dim, 1), ([float("nan")] * dim, 1), ([float("inf"), *[1.0] * (dim - 1)], 1), ([None, *[1.0] * (dim - 1)], 1),
            (out[0][0], None), (out[0][0][:5], 1)]
    return [(int(i), v, label) for i, (v, label) in enumerate(out)]


def embed_brute(rows, least):
    units, links, counts = {}, [], Counter()
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units.setdefault((label, len(v)), []).append((i, np.array(v, float) / np.linalg.norm(np.array(v, float))))
    for own in units.values():
        ids, m = [i for i, _ in own], np.stack([u for _, u in own])
        for a, b in np.argwhere(np.triu(m @ m.T >= least, 1)):
            links.append((ids[a], ids[b]))
            counts[ids[a]] += 1
            counts[ids[b]] += 1
    root = united([i for i, _, _ in rows], links)
    return sorted((i, counts[i], root[i], root[i] == i) for i, _, _ in rows)


@pytest.mark.parametrize("cell", [12_000, 60])
def test_embedding_groups(spark, cell):
    rows = vectors(np.random.default_rng(2), 120)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    out = sorted(got(embed_dedup.near_groups(df, cell=cell, spreads=12, trees=12)))
    want = embed_brute(rows, embed_dedup.COSINE)
    # the forest may miss a pair; it never adds one
    assert [r[0] for r in out] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(out, want))
    assert sum(a[1] for a in out) >= 0.99 * sum(b[1] for b in want)
    assert sum(a[2] == b[2] for a, b in zip(out, want)) >= 0.99 * len(want)


def test_embedding_leaves_cover():
    """Every point is in a leaf of every tree, and groups closer than a link stay whole."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(600, 32)), rng.normal(size=32) + 0.01 * rng.normal(size=(300, 32))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    whole = 0
    for tree in range(6):
        found = embed_dedup.leaves(points, ("t", tree), 0.93, leaf=50)
        assert set(np.concatenate(found)) == set(range(900))
        whole += any(set(range(600, 900)) <= set(rows) for rows in found)
    assert whole == 6


def test_embedding_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert got(embed_dedup.near_groups(df)) == []
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(got(embed_dedup.near_groups(odd)), key=repr) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
