"""Merkle manifest of a dataset: a SHA-256 midstate tree over its rows, with proofs and folding.

Rows are leaves of one tree per group, in the order of their keys, and the groups' roots are leaves of the tree above. Runs of `fan`
nodes become one by hashing their hex digests one after another. While a parent is hashed, a copy of the hash state is
retained before each child slot. To fold a replaced child, the copy at its slot resumes with the replacement and the siblings to its right
only; the siblings to its left are in the state already.

Trees are built in blocks of `fan ** DEPTH` neighbours, one block a task's group, and the blocks' roots again in blocks, until
one node is left. A block keeps its states while it is open; of the levels above a block only the siblings on its way to the root travel, one
row a block. A row is therefore read once, as its digest, however large its group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.llm.common import id_crc, saved

FAN = 2
#: Levels of the tree that one block spans.
DEPTH = 10
_PATH = "path array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Iterable[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def height(n: int, fan: int) -> int:
    """Levels above `n` leaves."""
    levels = 0
    while n > 1:
        n = -(-n // fan)
        levels += 1
    return levels


class Block:
    """A part of the tree over neighbouring nodes, with the retained hash states."""

    def __init__(self, nodes: list[bytes], levels: int, fan: int):
        self.fan, self.levels, self.states = fan, [nodes], []
        for _ in range(levels):
            below, above, states = self.levels[-1], [], []
            for at in range(0, len(below), fan):
                state = hashlib.sha256()
                for child in below[at:at + fan]:
                    states.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.levels.append(above)
            self.states.append(states)

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """Left and right siblings of a node and of each of its parents, as digests one after another."""
        out = []
        for nodes in self.levels[:-1]:
            first = at - at % self.fan
            out.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1:first + self.fan])))
            at //= self.fan
        return out

    def fold(self, at: int, replacement: bytes) -> bytes:
        """The block's root with another node at a place."""
        node = replacement
        for nodes, states in zip(self.levels, self.states):
            state = states[at].copy()
            state.update(node)
            for right in nodes[at + 1:at - at % self.fan + self.fan]:
                state.update(right)
            node = state.hexdigest().encode()
            at //= self.fan
        return node


class Way:
    """The levels above a block: the state at the slot of each ancestor, and what stands right of it."""

    def __init__(self, path: Iterable):
        self.path = [(step["left"].encode(), step["right"].encode()) for step in path]
        self.slots = [(hashlib.sha256(left), right) for left, right in self.path]

    def fold(self, node: bytes) -> bytes:
        for slot, right in self.slots:
            state = slot.copy()
            state.update(node)
            state.update(right)
            node = state.hexdigest().encode()
        return node


def numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """`idx`, the place from 0 in the order inside the group `g`, and `n`, the rows of the group.

    Rows are sorted by ranges of (g, order) and written; each file then only needs how many rows of its groups come before it.
    Nulls come first. The last column of the order should tell rows apart, or equal rows all go to one range.
    """
    rows = df.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
    rows = saved(rows, label).withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    mine = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(mine), F.lit(0)))
    parts = parts.withColumn("n", F.sum("here").over(Window.partitionBy("g"))).drop("here")
    return rows.join(parts, ["g", "part"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "before")


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / size))


def build(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> list[DataFrame]:
    """Rounds of block roots: nodes (g, idx, n, node), the roots of their blocks, and so on to one node a group."""
    size = fan ** depth
    rounds = [nodes]
    left = nodes.agg(F.max("n")).first()[0] or 0
    while left > 1 or len(rounds) == 1:
        def close(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            n = int(rows["n"].iloc[0])
            block = Block([x.encode() for x in rows.sort_values("idx")["node"]], min(depth, height(n, fan)), fan)
            return pd.DataFrame({"g": [key[0]], "idx": [key[1]], "n": [-(-n // size)], "node": [block.top.decode()]})

        below = _blocks(rounds[-1].select("g", "idx", "n", "node"), size)
        rounds.append(saved(below.groupBy("g", "block").applyInPandas(close, "g string, idx long, n long, node string"), "blocks"))
        left = -(-left // size)
    return rounds


def _step(path: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": a.decode(), "right": b.decode()} for a, b in path]


def descend(rounds: list[DataFrame], above: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """The way of every block of the first round to the root: (g, idx, path, subroot, root), from `above`, the ways of the last round's nodes."""
    size = fan ** depth

    def expand(key: tuple, nodes: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx")
        block = Block([x.encode() for x in nodes["node"]], min(depth, height(int(nodes["n"].iloc[0]), fan)), fan)
        rest, subroot, root = list(way["path"].iloc[0]), way["subroot"].iloc[0], way["root"].iloc[0]
        paths = [_step(block.siblings(i)) + [{"left": s["left"], "right": s["right"]} for s in rest] for i in range(len(nodes))]
        return pd.DataFrame({"g": key[0], "idx": nodes["idx"], "path": paths, "subroot": subroot, "root": root})

    for nodes in rounds[-2:0:-1]:
        pair = _blocks(nodes.select("g", "idx", "n", "node"), size).groupBy("g", "block").cogroup(above.withColumnRenamed("idx", "block").groupBy("g", "block"))
        above = saved(pair.applyInPandas(expand, f"g string, idx long, {_PATH}, subroot string, root string"), "ways")
    return above


@dataclass
class Manifest:
    """The leaves (g, idx, n, node, claim and the key), the rounds of their blocks, the subroots and the way of each block to the root."""

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    ways: DataFrame
    fan: int
    depth: int

    def folded(self, with_proof: bool = False) -> DataFrame:
        """One row per leaf: key, leaf, subroot, root, proof_sha256, folded_root, verified, and on request `proof`.

        folded_root is the root with the row's claim in place of its leaf and all siblings as they were. `proof` holds the siblings
        from the leaf up, left and right ones apart, as hex digests one after another; proof_sha256 is the hash of all of them.
        """
        fan, depth, size = self.fan, self.depth, self.fan ** self.depth
        kind = self.leaves.schema["key"].dataType.simpleString()

        def fold(key: tuple, rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("idx").reset_index(drop=True)
            block = Block([x.encode() for x in rows["node"]], min(depth, height(int(rows["n"].iloc[0]), fan)), fan)
            above = Way(way["path"].iloc[0])
            rest = b"".join([left + right for left, right in above.path])
            proofs, folded, paths = [], [], []
            for at, (leaf, claim) in enumerate(zip(rows["node"], rows["claim"])):
                path = block.siblings(at)
                proofs.append(hashlib.sha256(b"".join([left + right for left, right in path]) + rest).hexdigest())
                folded.append(above.fold(block.fold(at, (claim or leaf).encode())).decode())
                if with_proof:
                    paths.append(_step(path + above.path))
            out = pd.DataFrame({"doc_id": rows["key"], "leaf": rows["node"], "subroot": way["subroot"].iloc[0], "root": way["root"].iloc[0],
                                "proof_sha256": proofs, "folded_root": folded})
            out["verified"] = out["folded_root"] == out["root"]
            return out.assign(proof=paths) if with_proof else out

        schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        # keys travel as text, as pandas would turn whole numbers beside nulls into fractions
        mine = _blocks(self.leaves.withColumn("key", F.col("key").cast("string")), size).groupBy("g", "block").cogroup(self.ways.withColumnRenamed("idx", "block").groupBy("g", "block"))
        out = mine.applyInPandas(fold, schema + (", proof array<struct<left:string,right:string>>" if with_proof else ""))
        return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", claims: dict[str, Column] | None = None,
             fan: int = FAN, depth: int = DEPTH) -> Manifest:
    """The tree over the rows of `docs`, a leaf for each, from the named fields.

    `claims` gives other values of some fields; where they make another leaf, that is the row's claim, to be folded later. Rows of a
    group stand by key, null keys first, rows of one key by their leaf; repeated rows are leaves of their own. Groups stand
    by their name, null first, by UTF-8 bytes. Null fields and empty ones have different leaves. An empty table has no leaf, no
    root, and gives no rows. Other columns, whatever their names, are not read.
    """
    claims = claims or {}
    value = lambda c: F.col(f"`{c}`")
    leaf = leaf_hash([value(c) for c in fields])
    claim = leaf_hash([claims.get(c, value(c)) for c in fields])
    changed = F.lit(False)
    for c, other in claims.items():
        changed = changed | ~other.eqNullSafe(value(c))
    rows = docs.select(
        F.when(value(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value(group).cast("string"))).alias("g"),
        value(key).alias("key"), leaf.alias("node"), F.when(changed, claim).alias("claim"), F.monotonically_increasing_id().alias("row"))
    leaves = saved(numbered(rows, ["key", "node", "row"], "sorted-leaves").drop("row"), "leaves")
    rounds = build(leaves, fan, depth)
    tops = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "node")
    groups = saved(numbered(tops, ["name"], "sorted-subroots"), "subroots")
    over = build(groups, fan, depth)
    start = over[-1].select("g", "idx", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    ways = descend(over, start, fan, depth)
    # the last step down the tree of groups: a way for each subroot, under its group's name
    size = fan ** depth

    def expand(key: tuple, nodes: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("idx").reset_index(drop=True)
        block = Block([x.encode() for x in nodes["node"]], min(depth, height(int(nodes["n"].iloc[0]), fan)), fan)
        rest = [{"left": s["left"], "right": s["right"]} for s in way["path"].iloc[0]]
        return pd.DataFrame({"g": nodes["name"], "idx": 0, "path": [_step(block.siblings(i)) + rest for i in range(len(nodes))],
                             "subroot": nodes["node"], "root": way["root"].iloc[0]})

    pair = _blocks(groups, size).groupBy("g", "block").cogroup(ways.withColumnRenamed("idx", "block").groupBy("g", "block"))
    tops = saved(pair.applyInPandas(expand, f"g string, idx long, {_PATH}, subroot string, root string"), "group-ways")
    return Manifest(leaves, rounds, groups, descend(rounds, tops, fan, depth), fan, depth)


def tampered(n: Column, doc_id: str = "doc_id", every: int = 7) -> Column:
    """One more, where `every` divides the id's crc32; null stays null, a null id is never tampered with."""
    wide = n.cast("decimal(38,0)")
    return F.when(id_crc(doc_id) % every == 0, wide + 1).otherwise(wide)
