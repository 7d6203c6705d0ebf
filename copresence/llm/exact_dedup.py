"""Exact dedup with a heavy-hitter split: frequent digests are settled beside the map, the rest by a shuffle.

Texts are equal when identical after all characters of `[\\x20\\x09-\\x0D]` are deleted. A Misra-Gries summary names the
digests that may hold at least `support` of all rows (1/support of them at most). Their winners come from an exact second
pass with sums before the shuffle, are 1/support rows at most and therefore broadcast: rows of a hot digest never meet in one
task. All other digests are grouped by an ordinary shuffle of (digest, length, id). DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copresence.llm.common import saved

SUPPORT = 0.001


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text without blanks; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the one with the smallest id; a null id comes after all
    others, and of rows that are alike in this too one stays, the others count as dropped. A null text counts as empty, so
    null, empty and blank texts form one group. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    rows = saved(
        docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("text_sha256"),
                    F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), F.monotonically_increasing_id().alias("row")),
        "digests")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    size = F.count("*").alias("group_size")
    frequent = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    # at most 1/support rows of about 100 bytes
    winners = F.broadcast(saved(rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(best, size), "winners"))
    hot = rows.join(winners, "text_sha256")
    cold = rows.join(winners.select("text_sha256"), "text_sha256", "left_anti")
    settled = cold.join(cold.groupBy("text_sha256").agg(best, size), "text_sha256")
    return hot.unionByName(settled).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows that share an id are one document that came several times; where such rows carry a kept id, one of them stays.
    Whole rows meet the ids that stay in a merge join at every size, so the stage costs one shuffle of its input, always.
    """
    kept = exact_groups(docs, doc_id, text, support).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    kept = saved(kept, "kept").hint("merge")
    mine = docs.join(kept, F.col(doc_id).eqNullSafe(kept["_id"]) & (digest(F.col(text)) == kept["_sha"]), "left_semi")
    again = docs.groupBy(doc_id).count().where("count > 1")
    if not again.take(1):
        return mine
    again = again.select(F.col(doc_id).alias("_id"))
    alone = mine.join(again, F.col(doc_id).eqNullSafe(again["_id"]), "left_anti")
    # of rows with one id and one digest the longest text stays; they merge before the shuffle
    among = mine.join(again, F.col(doc_id).eqNullSafe(again["_id"]), "left_semi")
    order = F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), F.col(text))
    one = among.groupBy(F.col(doc_id).alias("_id"), digest(F.col(text)).alias("_sha")).agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("top"))
    return alone.unionByName(one.select("top.*"))
