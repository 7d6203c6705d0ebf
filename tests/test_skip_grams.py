"""Training pairs of walks against plain loops."""

from collections import Counter

from pyspark.sql import functions as F

from copresence.operators import graph, nullmodel

PRIME = 10007


def pick(keys):
    mixed = sum((k.cast("long") * m for k, m in zip(keys[1:], (104729, 1299709))), keys[0].cast("long") * 7919)
    return (F.pmod(mixed, F.lit(PRIME)) + 0.5) / PRIME


def u(*keys):
    return (sum(k * m for k, m in zip(keys, (7919, 104729, 1299709))) % PRIME + 0.5) / PRIME


def brute(walks, ids, window, negatives):
    out = Counter()
    for start, nodes in walks.items():
        couples = [(u(start, i, j), i, j) for i in range(len(nodes)) for j in range(len(nodes)) if i != j and abs(i - j) <= window]
        for _, i, j in couples:
            out[ids[nodes[i]], ids[nodes[j]], 1] += 1
        shuffled = [ids[nodes[i]] for _, i, _ in sorted(couples)]
        for n in range(int(len(couples) * negatives)):
            r, k = n % len(couples), n // len(couples)
            out[shuffled[r], min(int(u(start, r, k) * len(ids)) + 1, len(ids)), 0] += 1
    pairs = Counter()
    for (a, b, label), n in out.items():
        if a != b:
            pairs[min(a, b), max(a, b), label] += n
    return pairs


def test_equals_plain_loops(spark):
    walks = {1: list("abcabd"), 2: list("aa"), 3: ["e"], 4: list("badcebadce")}
    ids = {n: i + 1 for i, n in enumerate("abcde")}
    walked = spark.createDataFrame([(s, i, n) for s, ns in walks.items() for i, n in enumerate(ns)], "start long, step int, node string")
    names = spark.createDataFrame(list(ids.items()), "node string, node_id long")
    for window, negatives in ((2, 0), (1, 1), (3, 1.5), (9, 4), (2, 0.3)):
        got = {(r.target, r.context, r.label): r.weight for r in graph.skip_gram_examples(walked.repartition(3), names, window, negatives, pick, ("start",)).collect()}
        assert got == brute(walks, ids, window, negatives)


def test_share_of_negatives(spark):
    """Drawn contexts are even over the nodes, and as many as asked for."""
    walked = spark.range(400).select(F.col("id").alias("start"), F.lit(0).alias("walk"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step")).withColumn(
        "node", F.pmod(F.xxhash64("start", "step"), F.lit(50)))
    ids = spark.range(50).select(F.col("id").alias("node"), (F.col("id") + 1).alias("node_id"))
    rows = graph.skip_gram_examples(walked, ids, 2, 3, nullmodel.hashed(1)).collect()
    met, drawn = (sum(r.weight for r in rows if r.label == x) for x in (1, 0))
    assert abs(drawn / met / 3 - 1) < 0.05 and all(r.target < r.context for r in rows)
    seen = Counter()
    for r in rows:
        if r.label == 0:
            seen[r.target] += r.weight
            seen[r.context] += r.weight
    assert len(seen) == 50 and max(seen.values()) < 1.7 * min(seen.values())


def test_one_shuffle_for_walks_and_one_for_pairs(spark):
    """Couples are made where their walk is: no join of places with places."""
    walked = spark.createDataFrame([(s, i, n) for s in range(4) for i, n in enumerate("abca")], "start long, step int, node string")
    ids = spark.createDataFrame([(n, i + 1) for i, n in enumerate("abc")], "node string, node_id long")
    plan = graph.skip_gram_examples(walked, ids, 2, 1.5, pick, ("start",))._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subqueries")[0]
    assert main.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in main and "Window" not in main
