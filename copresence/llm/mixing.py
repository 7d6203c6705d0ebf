"""Mixing sources to target weights by hierarchical budgeting over domain-language-source trees.

A node's budget is spread over its children in proportion to their weights, no child getting more than its capacity (its
tokens times the epochs allowed); what a child cannot use goes to its siblings first. As the capacity of a node is that of
all its leaves, a shortage leaves a node only when the whole node is exhausted, and then goes to that node's siblings.
Budgets are whole tokens. Each leaf then takes a prefix of its seeded epochs: epoch 0 is all its documents in the
order of a hash of (seed, epoch, id), epoch 1 again all in another order, until the budget is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.llm.common import saved

LEVELS = ("domain", "lang", "source")
SEED = 7
_WIDE = "decimal(38,0)"
#: The order of an epoch is cut in this many pieces; only the piece in which the budget ends is sorted.
_DIGITS = 3


def n_words(text: Column) -> Column:
    """Runs of characters other than `[\\x20\\x09-\\x0D]`: the tokens that budgets count."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def allot(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Spread `budget` over the nodes of one parent: `share` = min(capacity, level x weight), rounded down.

    Children are taken by rising capacity/weight; one is full if its capacity is at most its part of what those before it left. The
    first that is not full fixes the level for all after it. A weight of null or below one counts as zero: such a child gets nothing.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    wide = lambda c: F.coalesce(c, F.lit(0)).cast(_WIDE)
    ranked = (
        nodes.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).cast("long")).where("weight > 0")
        .withColumn("left_budget", wide(F.col("budget")) - wide(F.sum("capacity").over(before)))
        .withColumn("left_weight", wide(F.sum("weight").over(whole)) - wide(F.sum("weight").over(before)))
        .withColumn("full", F.col("capacity") * F.col("left_weight") <= F.col("weight") * F.col("left_budget"))
    )
    level = F.min(F.when(~F.col("full"), F.struct((F.col("left_weight") * -1).alias("w"), F.col("left_budget").alias("b")))).over(whole)
    ranked = ranked.withColumn("level", level)
    share = F.when(F.col("full"), F.col("capacity")).otherwise(
        F.expr("cast(weight as decimal(38,0)) * level.b div -level.w"))
    return ranked.withColumn("share", share.cast("long")).drop("left_budget", "left_weight", "full", "level")


def budgets(leaves: DataFrame, total: Column | int, weights: dict[str, DataFrame], levels: tuple[str, ...] = LEVELS, epochs: int = 1) -> DataFrame:
    """The budget of every leaf. `leaves`: the levels and `tokens`; `weights`: for a level a table of that level and `weight`.

    Nodes without a row in the weights of their level, and levels without a table, weigh 1. Null is a node of its own.
    """
    levels = list(levels)
    tree = leaves.groupBy(*levels).agg((F.sum("tokens") * epochs).alias("capacity"), F.sum("tokens").alias("tokens"))
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = tree.groupBy(*levels[:depth + 1]).agg(F.sum("capacity").alias("capacity"))
        if depth:
            nodes = _join(nodes, above, parent, "inner").withColumnRenamed("share", "budget")  # noqa: F821
        else:
            nodes = nodes.withColumn("budget", F.lit(total).cast("long") if isinstance(total, int) else total.cast("long"))
        if level in weights:
            nodes = _join(nodes, weights[level].select(level, F.col("weight").alias("given")), [level], "left").withColumn("weight", F.coalesce("given", F.lit(1))).drop("given")
        else:
            nodes = nodes.withColumn("weight", F.lit(1))
        above = allot(nodes, parent, level).select(*levels[:depth + 1], "share")
    return _join(tree, above, levels, "inner").withColumnRenamed("share", "budget")


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equal keys, null equal to null; the right side's other columns follow."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(right[f"_{c}"])
    return left.join(right, match, how).drop(*[f"_{c}" for c in on])


def prefixes(rows: DataFrame, plan: DataFrame, levels: tuple[str, ...] = LEVELS, seed: int = SEED) -> DataFrame:
    """Rows with the epochs they take part in: `epoch`, `take` (of the row's `tokens`, all but for the leaf's last one).

    Full epochs take every row. In the last, partial epoch rows stand in the order of a hash; the sums of its 4096 pieces say
    which piece holds the end, pieces before it are taken whole, and only its rows are sorted.
    """
    levels = list(levels)
    placed = _join(rows, plan.select(*levels, F.col("tokens").alias("all_tokens"), "budget"), levels, "inner").where("budget > 0 and tokens > 0")
    placed = placed.withColumn("full", F.floor(F.col("budget") / F.col("all_tokens")).cast("int")).withColumn("rest", F.expr("budget % all_tokens"))
    whole = placed.where("full > 0").withColumn("epoch", F.explode(F.expr("sequence(0, full - 1)"))).withColumn("take", F.col("tokens"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    part = placed.where("rest > 0").withColumn("epoch", F.col("full")).withColumn("order", order).withColumn("piece", F.substring("order", 1, _DIGITS))
    sums = saved(part.groupBy(*levels, "piece").agg(F.sum("tokens").alias("piece_tokens"), F.max("rest").alias("rest")), "pieces")
    upto = Window.partitionBy(*levels).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("piece_tokens").over(upto), F.lit(0))).where("before < rest").select(*levels, "piece", "piece_tokens", "before")
    near = _join(part, sums, [*levels, "piece"], "inner")
    inside = near.where("before + piece_tokens <= rest").withColumn("take", F.col("tokens"))
    ahead = Window.partitionBy(*levels, "piece").orderBy("order", F.col("doc_id"), F.col("row")).rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        near.where("before + piece_tokens > rest").withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
        .where("before < rest").withColumn("take", F.least(F.col("tokens"), F.col("rest") - F.col("before")))
    )
    columns = [*rows.columns, "epoch", "take"]
    return whole.select(*columns).unionByName(inside.select(*columns)).unionByName(edge.select(*columns))


def mix(docs: DataFrame, domain: Column, share: float, weights: dict[str, DataFrame], epochs: int = 1, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """What a corpus of `share` (a fraction) of all tokens at the target weights takes from `docs`.

    One row for each (document, epoch) that is taken: doc_id, domain, lang, source, epoch, n_tokens, take_tokens. A document is
    cut short only where its leaf's budget ends. Documents without words (null, empty, blank) count no tokens and are never taken. Null
    languages, sources and domains are leaves of their own. Rows that share an id are taken one by one. An empty table gives no rows.
    """
    rows = saved(
        docs.select(F.col(doc_id).alias("doc_id"), domain.alias("domain"), F.col("lang"), F.col("source"), n_words(F.col(text)).alias("tokens"),
                    F.monotonically_increasing_id().alias("row")), "tokens")
    leaves = saved(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves").where("tokens > 0")
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("long")).first()[0] or 0
    plan = saved(budgets(leaves, int(total), weights, epochs=epochs), "budgets")
    return prefixes(rows, plan, seed=seed).select(
        "doc_id", *LEVELS, "epoch", F.col("tokens").alias("n_tokens"), F.col("take").alias("take_tokens"))
