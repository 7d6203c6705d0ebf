"""Substring dedup against windows counted one by one."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from copresence.llm import substring_dedup as sd
from odd_rows import ODD, got


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept text)."""
    docs = [(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc_id, text in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in docs:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(window)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def patched(seed, n, words, passages=6, longest=90):
    """Documents of few different words that share passages, whole and in part, also with one word changed."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(words)
    shared = [[word() for _ in range(rnd.randint(8, longest))] for _ in range(passages)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 5)):
            text += [word() for _ in range(rnd.randint(0, 30))]
            part = list(rnd.choice(shared))
            if rnd.random() < 0.5:
                part = part[rnd.randrange(len(part)):] + part[:rnd.randrange(len(part))]
            if rnd.random() < 0.4 and part:
                part[rnd.randrange(len(part))] = word()
            text += part
        out.append((i, rnd.choice([" ", "  ", "\n", "\t "]).join(text)))
    return out


WORDS = [f"w{i}" for i in range(400)]
CASES = {
    "patched": patched(1, 60, WORDS), "few words": patched(2, 40, ["a", "b", "c"]), "one word": [(i, "a " * i) for i in range(0, 60, 7)],
    "copies": patched(3, 12, WORDS) * 3, "odd": ODD, "periodic": [(1, "a b c " * 40), (2, "b c a " * 11), (3, "c b a " * 30)], "empty": [],
    "hot": [(i, f"{' '.join(WORDS[:12])} {' '.join(random.Random(i).choices(WORDS, k=30))}") for i in range(50)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("window, sizes", [(35, {}), (10, {"block": 7, "hot": 4}), (3, {"block": 16})])
def test_equals_brute(table, case, window, sizes):
    out = got(sd.drop_repeats(table(CASES[case]), window=window, with_text=True, **sizes))
    assert sorted(((a, b, c, e) for a, b, c, _, e in out), key=repr) == brute(CASES[case], window)
    assert all(d == hashlib.sha256(e.encode()).hexdigest() for _, _, _, d, e in out)


@pytest.mark.parametrize("window", [1, 2, 8, 35, 61, 80])
def test_pieces_hold_every_window_once(window):
    docs = [sd.words_of(t) for _, t in CASES["patched"] + CASES["few words"]]
    found = list(sd.pieces(docs, window))
    windows = Counter((d, s + i) for d, s, n, _, _ in found for i in range(n))
    assert windows == Counter((d, i) for d, w in enumerate(docs) for i in range(len(w) - window + 1))
    assert max(n for _, _, n, _, _ in found) <= 62
    anchors, wholes = {}, {}
    for d, s, n, anchor, seg in found:
        assert wholes.setdefault(seg, docs[d][s:s + n + window - 1]) == docs[d][s:s + n + window - 1]
        for i in range(s, s + n):  # equal windows have equal anchors
            assert anchors.setdefault(tuple(docs[d][i:i + window]), anchor) == anchor


@pytest.mark.parametrize("seed", range(8))
def test_factors(seed):
    """Longest matches and the duplicates along factors and their borders, beside plain loops."""
    rnd = random.Random(seed)
    texts = [[rnd.choice([b"a", b"b", b"c"][:1 + seed % 3]) for _ in range(rnd.randint(1, 40))] for _ in range(12)]
    at = sd.Reference(texts)
    suffixes = {int(b) + i: tuple(t[i:]) for b, t in zip(at.begins, texts) for i in range(len(t))}

    def longest(p):
        return max(next((n for n, (x, y) in enumerate(zip(suffixes[p], s)) if x != y), min(len(s), len(suffixes[p]))) for q, s in suffixes.items() if q != p)

    if len(suffixes) > 1:
        assert at.longest(np.array(list(suffixes))).tolist() == [longest(p) for p in suffixes]
    for window in (1, 4, 9):
        seen = Counter(s[:window] for s in suffixes.values() if len(s) >= window)
        assert np.flatnonzero(at.duplicates(window)).tolist() == sorted(p for p, s in suffixes.items() if len(s) >= window and seen[s[:window]] > 1)


def test_texts_are_joined_without_an_exchange(spark, table):
    name, texts = sd._bucketed(table(CASES["patched"]).selectExpr("cast(doc_id as string) as key", "text"), "key", "plan")
    few = spark.createDataFrame([("1", 2)], "key string, n int").groupBy("key").count()
    plan = texts.join(few.hint("merge"), "key", "left")._jdf.queryExecution().executedPlan().toString()
    left = plan[:plan.index("Scan parquet")]
    spark.sql(f"DROP TABLE {name}")
    assert "Exchange" not in left and "SortMergeJoin" in left
