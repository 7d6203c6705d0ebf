"""Hard-negative mining: integer scores of anchors against all rows by Strassen's product, best lists that merge.

Anchors are a stated query set and are scored against every row. Rows and anchors are dealt to cells of bounded size; a cell
multiplies tiles of int64 vectors by Strassen's recursion (seven half-size products for eight, zero padding, integer additions that
wrap, so a product is exact whenever it fits 64 bits itself). A first pass keeps the best rows of an anchor's own label, a second the
best rows of other labels inside the score window of each positive. Best lists are short and merge in any order: tile by tile in a
cell, then cell by cell with a rank limit on both sides of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from copresence.llm.common import counted, saved

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score in hundredths of the positive's, both ends included.
WINDOW = (50, 95)
#: Anchors and rows of a cell, and the sides of a tile.
CELL_ANCHORS = 4096
CELL_ROWS = 8192
TILE = 512
#: Products with a side below this are not halved further.
LEAF = 16
_EMPTY = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of int64 matrices; exact modulo 2**64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, h = m // 2, n // 2, k // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    np.add(m1 + m4, m7 - m5, out=out[:i, :j])
    np.add(m3, m5, out=out[:i, j:])
    np.add(m2, m4, out=out[i:, :j])
    np.add(m1 - m2, m3 + m6, out=out[i:, j:])
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices. Where one may leave 64 bits, all are computed in whole
    numbers of any size and end at the largest or smallest 64-bit number (but the smallest of all, which marks empty places)."""
    reach = a.shape[1] * max((abs(int(v)) for v in (a.min(initial=0), a.max(initial=0))), default=0) * max(abs(int(v)) for v in (b.min(initial=0), b.max(initial=0)))
    if reach <= _MOST:
        return strassen(a, np.ascontiguousarray(b.T))
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, _EMPTY + 1, _MOST).astype(np.int64)


class Best:
    """For each of several owners the `k` best (score, place) met so far: higher scores first, ties by smaller place.

    Tiles must be offered by rising place; then a tie with an earlier tile is settled by keeping the earlier one first.
    """

    def __init__(self, owners: int, k: int):
        self.k = k
        self.score = np.full((owners, 0), _EMPTY)
        self.place = np.zeros((owners, 0), np.int64)

    def offer(self, tile: np.ndarray, first: int) -> None:
        """Merge a tile of scores (owners x places from `first`); empty places hold the smallest number. The tile is used up."""
        each = np.arange(len(tile))
        found_score, found_place = [self.score], [self.place]
        for _ in range(min(self.k, tile.shape[1])):
            at = tile.argmax(axis=1)
            top = tile[each, at]
            if (top == _EMPTY).all():
                break
            found_score.append(top[:, None])
            found_place.append(at[:, None] + first)
            tile[each, at] = _EMPTY
        score, place = np.concatenate(found_score, axis=1), np.concatenate(found_place, axis=1)
        order = np.argsort(~score, axis=1, kind="stable")[:, :self.k]  # ~x falls as x rises, also at the ends of the range
        self.score, self.place = np.take_along_axis(score, order, 1), np.take_along_axis(place, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, place and score of all that were kept."""
        owner, rank = np.nonzero(self.score != _EMPTY)
        return owner, self.place[owner, rank], self.score[owner, rank]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _sides(cell: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]:
    """Anchors and rows of a cell, rows by id, with their vectors; shorter vectors end in zeros."""
    width = max(max(map(len, cell["v"]), default=0), 1)
    anchors = cell[cell["as_anchor"]].reset_index(drop=True)
    rows = cell[~cell["as_anchor"]].sort_values(["vec_id", "row"], kind="stable").reset_index(drop=True)
    return anchors, _matrix(anchors["v"], width), rows, _matrix(rows["v"], width)


def _tiles(a: np.ndarray, b: np.ndarray, tile: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    for i in range(0, len(a), tile):
        for j in range(0, len(b), tile):
            yield slice(i, i + tile), slice(j, j + tile), scores(a[i:i + tile], b[j:j + tile])


def _blank(tile: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.where(keep, tile, _EMPTY)


def best_positives(cell: pd.DataFrame, k: int, tile: int = TILE) -> pd.DataFrame:
    """The k best other rows of its label for each anchor of a cell."""
    anchors, a, rows, b = _sides(cell)
    labels, all_labels = anchors["label"].to_numpy(), rows["label"].to_numpy()
    own, all_own = anchors["row"].to_numpy(), rows["row"].to_numpy()
    best: dict[int, Best] = {}
    for i, j, found in _tiles(a, b, tile):
        keep = (labels[i, None] == all_labels[None, j]) & (own[i, None] != all_own[None, j])
        best.setdefault(i.start, Best(len(found), k)).offer(_blank(found, keep), j.start)
    out = []
    for start, kept in best.items():
        owner, place, score = kept.found()
        out.append(pd.DataFrame({"anchor_row": own[start + owner], "positive_id": rows["vec_id"].to_numpy()[place], "positive_row": all_own[place], "positive_score": score}))
    return pd.concat(out) if out else pd.DataFrame({"anchor_row": [], "positive_id": [], "positive_row": [], "positive_score": []}, dtype="int64")


def best_negatives(cell: pd.DataFrame, k: int, window: tuple[int, int], tile: int = TILE) -> pd.DataFrame:
    """For each anchor of a cell and each of its positives the k best rows of other labels in the positive's window."""
    anchors, a, rows, b = _sides(cell)
    labels, all_labels = anchors["label"].to_numpy(), rows["label"].to_numpy()
    own = anchors["row"].to_numpy()
    most = max(map(len, anchors["positives"]), default=0)
    # the window's ends in whole numbers: low*p <= 100*s <= high*p
    bounds = [[[-(-window[0] * int(p) // 100), window[1] * int(p) // 100] for p in ps] + [[1, 0]] * (most - len(ps)) for ps in anchors["positives"]]
    bounds = np.clip(np.array(bounds, dtype=object).reshape(len(anchors), most, 2), _EMPTY + 1, _MOST).astype(np.int64)
    best: dict[tuple[int, int], Best] = {}
    for i, j, found in _tiles(a, b, tile):
        other = labels[i, None] != all_labels[None, j]
        for p in range(most):
            keep = other & (found >= bounds[i, p, 0, None]) & (found <= bounds[i, p, 1, None])
            best.setdefault((i.start, p), Best(len(found), k)).offer(_blank(found, keep), j.start)
    out = []
    for (start, p), kept in best.items():
        owner, place, score = kept.found()
        out.append(pd.DataFrame({"anchor_row": own[start + owner], "nth": p, "negative_id": rows["vec_id"].to_numpy()[place],
                                 "negative_row": rows["row"].to_numpy()[place], "negative_score": score}))
    names = ["anchor_row", "nth", "negative_id", "negative_row", "negative_score"]
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in names}, dtype="int64")


def _dealt(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, cell_anchors: int, cell_rows: int) -> DataFrame:
    """Every pair of a share of the anchors and a share of the rows is one cell."""
    across, down = -(-max(n_anchors, 1) // cell_anchors), -(-max(n_rows, 1) // cell_rows)
    share = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    columns = ["row", "vec_id", "label", "v", "positives", "as_anchor", "x", "y"]
    one = anchors.withColumn("as_anchor", F.lit(True)).withColumn("x", share(across, 1)).withColumn("y", each(down)).select(*columns)
    all_ = rows.withColumn("positives", F.array().cast("array<long>")).withColumn("as_anchor", F.lit(False)).withColumn("y", share(down, 2)).withColumn("x", each(across))
    return one.unionByName(all_.select(*columns)).repartition(min(across * down, 10_000), "x", "y")


def mine(vectors: DataFrame, anchor: str, label: str, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
         cell_anchors: int = CELL_ANCHORS, cell_rows: int = CELL_ROWS, tile: int = TILE) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id and embedding; `anchor` and `label` are SQL expressions over its columns. Rows whose id, label, vector
    or any component is null, or with a component that is not finite, take no part. A component x counts as floor(256*x), at most the
    largest 64-bit number; of vectors of different lengths the shorter one counts as filled with zeros. Anchors without a positive, and
    positives without a negative, give no row. Rows that share an id are rows of their own, also as anchors; equal scores are
    ordered by id. An empty table gives no rows.
    """
    x = lambda c: F.col(c)
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows, seen = counted(
        vectors.where(sound).select(x("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), F.expr(anchor).alias("is_anchor"),
                                    F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("v"), F.monotonically_increasing_id().alias("row"))
        .where("vec_id is not null and label is not null"),
        "vectors", n_anchors=F.count_if("is_anchor"))
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    sizes = (seen["n_anchors"], seen["n"], cell_anchors, cell_rows)

    def positives_of(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        return best_positives(cell, positives, tile)

    def negatives_of(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        return best_negatives(cell, negatives, window, tile)

    cells = _dealt(anchors.withColumn("positives", F.array().cast("array<long>")), rows, *sizes).groupBy("x", "y")
    found = cells.applyInPandas(positives_of, "anchor_row long, positive_id long, positive_row long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row"))
    chosen = saved(found.withColumn("nth", nth - 1).where(F.col("nth") < positives), "positives")
    lists = chosen.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda s: s["positive_score"]).alias("positives"))
    with_lists = anchors.join(lists.withColumnRenamed("anchor_row", "row"), "row")  # at most `positives` numbers a row
    cells = _dealt(with_lists, rows, *sizes).groupBy("x", "y")
    found = cells.applyInPandas(negatives_of, "anchor_row long, nth int, negative_id long, negative_row long, negative_score long")
    order = Window.partitionBy("anchor_row", "nth").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return kept.join(chosen, ["anchor_row", "nth"]).join(named, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
