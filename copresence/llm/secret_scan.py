"""Secret scans with multipart credential linking.

Base spans are found by three patterns. Weak candidates (bare key-like strings, and endpoints) say little by themselves: one is
reported only when complementary parts stand in its scope, that is within `REACH` characters in the same document. Parts are linked by an
interval join: the scope of each part is filed under the stretches of `REACH` characters that it touches, parts meet in the
stretch where the later of the two begins, and the exact distance is tested there.

Positions are code points, ends exclusive. DataFrame functions only: matches are cut out together with the gaps before them, each search
going on where the last match ended, and positions are running sums of lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from copresence.llm.common import saved

REACH = 200
# fixed values: the base kinds in their order; pattern with one group, and the least length of that group
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
    "access": (r"(AKIA[A-Z0-9]{12,})", 16),
    "hex": (r"([0-9a-f]{32,})", 32),
}
#: Weak kinds: a bare key-like string (both cases and a digit), an endpoint, the name of an account.
WEAK = {
    "key": (r"([A-Za-z0-9+/]{20,}={0,2})", 20),
    "endpoint": (r"((?i:https?|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+)", 8),
    "account": (r"(?i:user|username|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]+)", 3),
}
#: What else the value of a kind must hold.
HOLDS = {"key": ["[0-9]", "[A-Z]", "[a-z]"]}
#: A weak part is reported when one kind of each group stands in its scope.
NEEDS = {
    "key": [["access", "account"]],
    "endpoint": [["access", "account"], ["assign", "key", "hex"]],
    "account": [["assign", "key", "hex"], ["endpoint"]],
}
KINDS = [*BASE, *WEAK]
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def found(text: Column, kind: str) -> Column:
    """Array of (start, kind, end) of the leftmost non-overlapping matches whose group is long enough and holds what it must; any other match
    still takes its characters. `\\G` makes each search start where the last match ended, so a text is read once."""
    pattern, least = (BASE | WEAK)[kind]
    whole = F.lit(r"(?s)\G(.*?)(" + pattern + ")")
    cut = F.arrays_zip(*[F.regexp_extract_all(text, whole, F.lit(i)).alias(name) for i, name in ((1, "gap"), (2, "match"), (3, "value"))])
    none = F.array().cast(_SPANS)

    def placed(done: Column, m: Column) -> Column:
        start = done["at"] + F.length(m["gap"])
        end = start + F.length(m["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end")))
        good = F.length(m["value"]) >= least
        for held in HOLDS.get(kind, []):
            good = good & m["value"].rlike(held)
        return F.struct(end.alias("at"), F.when(good, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    spans = F.aggregate(cut, F.struct(F.lit(0).alias("at"), none.alias("spans")), placed, lambda done: done["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts of (row, start, kind, end) that have all they need within `reach` characters."""
    # a part is filed under every stretch from its start to the end of its scope; of two parts in scope of each other, the later starts in
    # a stretch of the earlier, and they are compared there only
    filed = parts.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") + reach) / reach))))
    other = filed.select("row", "stretch", F.col("start").alias("start2"), F.col("kind").alias("kind2"), F.col("end").alias("end2"))
    late, early_end = F.greatest("start", "start2"), F.when(F.col("start") <= F.col("start2"), F.col("end")).otherwise(F.col("end2"))
    met = (
        filed.where(F.col("kind") >= len(BASE)).join(other, ["row", "stretch"])
        .where((F.col("stretch") == F.floor(late / reach)) & (late <= early_end + reach) & (F.col("kind") != F.col("kind2")))
        .groupBy("row", "start", "kind", "end").agg(F.collect_set("kind2").alias("near"))
    )
    enough = F.lit(False)
    for kind, groups in NEEDS.items():
        has = F.col("kind") == KINDS.index(kind)
        for group in groups:
            has = has & F.arrays_overlap("near", F.array(*[F.lit(KINDS.index(k)) for k in group]))
        enough = enough | has
    return met.where(enough).select("row", "start", "kind", "end")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans holds base spans and linked weak ones as `kind:start:end`; a weak part that overlaps a base span is left out. A null or
    empty text has none. Repeated rows and null ids are scanned one by one; an empty table gives no rows. Other columns are not read.
    """
    value = F.coalesce(F.col("text"), F.lit(""))
    scans = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")).select(
        "doc_id", "row", F.concat(*[found(value, k) for k in BASE]).alias("base"), F.concat(*[found(value, k) for k in WEAK]).alias("weak"))
    scans = saved(scans, "spans")
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    parts = scans.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", free)).alias("part")).select("row", "part.*")
    weak = linked(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    weak = saved(weak, "linked")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return scans.join(weak, "row", "left").select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _named(F.concat("base", F.coalesce("linked", F.array().cast(_SPANS)))).alias("spans"),
        F.coalesce(F.size("linked"), F.lit(0)).cast("long").alias("n_linked"))
