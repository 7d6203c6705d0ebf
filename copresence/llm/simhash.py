"""SimHash near-dedup over an inverted index of byte positions with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits share six of them at least.
Lists of a single positional byte would hold 1/256 of all fingerprints each, and their pairs would grow with the square of
the input, so a list is keyed by four positional bytes: with the bytes taken in four twos, two differing bits leave two twos
untouched, and one of the six lists of two twos holds both fingerprints. For each pair that meets in a list the shared
positional bytes are tallied, pairs below the guaranteed six are dropped, and the rest is verified bit by bit.

Lists longer than `longest` (a large group of near copies) are not paired: in them each fingerprint is filed under itself
and under its one-bit neighbours outside the four shared bytes. Two fingerprints at most two bits apart meet in one of these files, and two
that meet are at most two bits apart, so linking each file to its smallest member yields the same components at a linear cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from copresence.llm.common import components, counted, saved

SEED = 42
WORDS = 3
MAX_BITS = 2
LONGEST = 64
_BLOCK = 1 << 18
# the two twos of bytes that key each of the six lists
_LISTS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit SimHash of a text: majority bits of the XXH64 of its word shingles, repeats included.

    A-Z are lower-cased, words are runs without `[\\x20\\x09-\\x0D]`. A text with fewer words is one shingle, one without words is zero.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(len(tokens) - words + 1, 1)
    first, last = starts[:count].tolist(), ends[len(tokens) - count:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[at:at + _BLOCK], last[at:at + _BLOCK])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count).view(np.int64)[0])


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": [fingerprint(t) for t in frame["text"]]})


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes are equal."""
    both = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(both, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))


def _two(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * at).bitwiseAND(F.lit(0xFFFF))


def links(fps: DataFrame, max_bits: int = MAX_BITS, longest: int = LONGEST) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` of which the components are those of all pairs within `max_bits`
    (2 at most) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the lists guarantee pairs of at most two differing bits")
    key = F.explode(F.array(*[
        F.struct(F.lit(n).alias("list"), F.shiftleft(_two(F.col("fp"), i), 16).bitwiseOR(_two(F.col("fp"), j)).alias("key"))
        for n, (i, j) in enumerate(_LISTS)])).alias("at")
    filed, seen = counted(fps.select("fp", key).select("fp", "at.*"), "postings")
    sizes = saved(filed.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1"), "list-sizes", seen["n"])
    short, long = (filed.join(sizes.where(c).drop("n"), ["list", "key"]) for c in (f"n <= {longest}", f"n > {longest}"))
    a, b = F.col("a"), F.col("b")
    pairs = (
        short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b"), ["list", "key"]).where("a < b")
        .where((shared_bytes(a, b) >= 8 - max_bits) & (differing(a, b) <= max_bits)).select("a", "b")
    )
    return pairs.unionByName(_by_neighbours(long, max_bits)).distinct()


def _by_neighbours(long: DataFrame, max_bits: int) -> DataFrame:
    fp = F.col("fp")
    free = F.lit(None)
    for n, (i, j) in enumerate(_LISTS):
        bits = [b for two in range(4) if two not in (i, j) for b in range(16 * two, 16 * two + 16)]
        masks = [_signed(1 << b) for b in bits] if max_bits else []
        free = F.when(F.col("list") == n, F.array(*[F.lit(m).cast("long") for m in [0, *masks]])).otherwise(free)
    near = long.select("fp", F.explode(free).alias("mask")).select("fp", fp.bitwiseXOR(F.col("mask")).alias("near"))
    near, seen = counted(near, "neighbours")
    least = near.groupBy("near").agg(F.min("fp").alias("b"), F.max("fp").alias("other")).where("b < other").drop("other")
    least = saved(least, "centres", seen["n"])
    met = near.join(least, "near").where("fp <> b").select(fp.alias("a"), "b")
    return met.where(differing(F.col("a"), F.col("b")) <= max_bits)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, longest: int = LONGEST) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hex digits), component_id, n_same, kept.

    component_id is the smallest id reachable over links, n_same the number of rows with the same fingerprint, kept is true
    where the id is the component's. Null, empty and blank texts have fingerprint zero and are linked like any other. A row with a null id
    takes part in the links but names no component: null where no row of the component has an id, and then one is not kept
    over another (kept is true for all). Rows that share an id are judged one by one. An empty table gives no rows. Other
    columns are not read.
    """
    rows = saved(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .mapInPandas(_fingerprints, "doc_id long, fp long"), "fingerprints")
    fps, seen = counted(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same")), "distinct")
    roots = saved(components(links(fps.select("fp"), max_bits, longest)), "roots", seen["n"])
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only components of several fingerprints are summed up again
    linked = placed.join(roots.select(F.col("node").alias("fp")), "fp", "left_semi")
    low = saved(linked.groupBy("root").agg(F.min("first").alias("low")), "component-ids", seen["n"])
    named = saved(
        placed.join(low, "root", "left").select("fp", "n_same", F.when(F.col("low").isNotNull(), F.col("low")).otherwise(F.col("first")).alias("component_id")),
        "named", seen["n"])
    return rows.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` whose id names their component, with all their columns; rows of a component without an id all stay.

    An id stands for a document: rows that share a kept id all stay, so drop exact copies first. Whole rows meet the ids
    that stay in a merge join at every size, so the stage costs one shuffle of its input, always.
    """
    kept = saved(near_groups(docs, doc_id, text, max_bits).where("kept").select(F.col("doc_id").alias("_id")).distinct(), "kept").hint("merge")
    return docs.join(kept, F.col(doc_id).eqNullSafe(kept["_id"]), "left_semi")
