"""Bootstrap replicates as vectors.

Rows are first summed to cells of equal values. All rows of a cell are drawn together: a replicate takes a Poisson number of them,
whose mean is the sum of the rows' means, so a cell costs one vector of counts however many rows stand behind it, and
neither rows nor cells are ever copied once per replicate. Cells lie in pieces of the value range, and a piece is the unit of work: it returns a
few vectors with one number for each replicate, and the pieces of a group are put together from those.

A count depends on the cell's key and the replicate only, not on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from copresence.functions.draws import hashed_poisson
from copresence.functions.tails import normal_tail
from copresence.operators.ordered import piece_of, split_points
from copresence.session import beside, cut

#: (keys, means, replicates) to a matrix of counts, a row for each key.
Counts = Callable[[np.ndarray, np.ndarray, int], np.ndarray]

#: Cells of one piece, cells whose counts are in memory at once, and replicates of them that are ranked at once.
PIECE = 20_000
BLOCK = 500
STRIP = 64


def seeded(seed: int) -> Counts:
    """Poisson counts by inversion of numbers hashed from key, replicate and seed."""
    def counts(keys: np.ndarray, means: np.ndarray, n: int) -> np.ndarray:
        return hashed_poisson(keys, means, n, seed)

    return counts


def _cells(df: DataFrame, by: list[str], values: dict[str, Column], mean: Column, key: Column | None) -> DataFrame:
    """Rows with equal values as one: `_mean`, the sum of their means, and `_key`."""
    rows = df.select(*by, *[v.cast("double").alias(n) for n, v in values.items()], mean.cast("double").alias("_mean"))
    cells = rows.groupBy(*by, *values).agg(F.sum("_mean").alias("_mean"))
    return cut(cells.withColumn("_key", F.xxhash64(*by, *values) if key is None else key.cast("long")))


def _in_pieces(cells: DataFrame, x: str) -> DataFrame:
    """Cells with the piece of the value range that they lie in, and a part of it. Pieces are cut by the number of cells; a value with
    more cells than one piece should have is a piece of its own, in parts."""
    n = cells.count()
    if n <= PIECE:
        return cells.withColumns({"_piece": F.lit(0), "_part": F.lit(0)})
    heavy = {r[0]: r[1] for r in cells.groupBy(x).count().where(F.col("count") > PIECE).collect()}  # n/PIECE values at most
    cuts = {*split_points(cells, x, 1 + n // PIECE), *heavy, *(float(np.nextafter(v, -np.inf)) for v in heavy)}
    parts = 1 + max(heavy.values(), default=0) // PIECE
    part = F.when(F.col(x).isin(list(heavy)), F.pmod(F.xxhash64("_key"), F.lit(parts))).otherwise(0).cast("int")
    return cells.withColumns({"_piece": piece_of(F.col(x), sorted(cuts)), "_part": part})


def _fields(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def _keyed(by: list[str], key: tuple, columns: dict) -> pd.DataFrame:
    return pd.DataFrame({**{c: [k] for c, k in zip(by, key)}, **{n: [v] for n, v in columns.items()}})


def _blocks(cells: pd.DataFrame, counts: Counts, n: int, size: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for at in range(0, len(cells), size):
        part = cells.iloc[at:at + size]
        yield part, counts(part["_key"].to_numpy(np.int64), part["_mean"].to_numpy(float), n)


def _located(totals: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece that holds a median: the replicates, the weight wanted from the piece's start, and the next value behind the piece."""
    upto = np.cumsum(totals, axis=0)
    want = upto[-1] / 2
    at = np.where(upto[-1] > 0, (upto < want).sum(axis=0), -1)
    for piece in np.unique(at[at >= 0]):
        sims = np.flatnonzero(at == piece)
        behind = np.vstack([first[piece + 1:, sims], np.full(len(sims), np.inf)])
        yield piece, sims, want[sims] - (upto[piece, sims] - totals[piece, sims]), np.nanmin(behind, axis=0)


class _Search:
    """Values by rising order, with their weights in each replicate, until the wanted weight is reached."""

    def __init__(self, want: np.ndarray):
        self.want, self.run = want, np.zeros(len(want))
        self.value, self.last = np.full(len(want), np.nan), np.full(len(want), np.nan)
        self.even = np.zeros(len(want), bool)  # reached exactly: the next value counts too

    def offer(self, xs: np.ndarray, weights: np.ndarray) -> None:
        if not len(xs):
            return
        there, each = weights > 0, np.arange(len(self.want))
        upto = self.run + np.cumsum(weights, axis=0)
        reached = there & (upto >= self.want) & np.isnan(self.value)
        new, at = reached.any(axis=0), reached.argmax(axis=0)
        start = np.where(new, at + 1, 0)  # a value for an even replicate must come behind the reached one
        exact = new & (upto[at, each] == self.want)
        self.value[new] = xs[at[new]]
        self.even |= exact
        later = there & (np.arange(len(xs))[:, None] >= start) & self.even
        done = later.any(axis=0)
        self.value[done] = (self.value[done] + xs[later[:, done].argmax(axis=0)]) / 2
        self.even &= ~done
        seen = there.any(axis=0)
        self.last[seen] = xs[len(xs) - 1 - there[::-1, seen].argmax(axis=0)]
        self.run = upto[-1]

    def found(self, after: np.ndarray) -> np.ndarray:
        value = np.where(np.isnan(self.value), self.last, self.value)  # the running sum may miss the piece's total by rounding
        return np.where(self.even & np.isfinite(after), (value + after) / 2, value)


def medians(df: DataFrame, by: list[str], x: str, w: str, n: int = 1000, counts: Counts | None = None, key: Column | None = None) -> DataFrame:
    """Weighted median of every replicate: by, sim (from 1), value. A replicate that drew no row has none.

    The smallest value whose running weight reaches half of all; on equality the mean of it and the next one. Only the pieces
    that hold the median of some replicate are opened. `key`, a column over by, `_x` and `_w`, names a cell for the draws.
    """
    counts, block = counts or seeded(1), BLOCK
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.col(w) > 0))
    cells = _in_pieces(_cells(rows, by, {"_x": F.col(x), "_w": F.col(w)}, F.lit(1.0), key), "_x")
    fields, keys = _fields(df, by), [*by, "_piece"]
    vectors = f"{fields}_piece int, low double, high double, weight array<double>, first array<double>"

    def total(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        weight, first = np.zeros(n), np.full(n, np.nan)
        for cells, drawn in _blocks(part.sort_values("_x"), counts, n, block):
            weight += cells["_w"].to_numpy() @ drawn
            if np.isnan(first).any():
                hit = (drawn > 0).any(axis=0) & np.isnan(first)
                first[hit] = cells["_x"].to_numpy()[(drawn[:, hit] > 0).argmax(axis=0)]
        return _keyed(keys, k[:-1], {"low": part["_x"].min(), "high": part["_x"].max(), "weight": weight, "first": first})

    def together(k: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        first = np.vstack([*parts["first"], np.full(n, np.inf)]) if len(parts) > 1 else None
        first = parts["first"].iloc[0] if first is None else np.nanmin(first, axis=0)
        first = np.where(np.isinf(first), np.nan, first)
        return _keyed(keys, k, {"low": parts["low"].min(), "high": parts["high"].max(), "weight": np.sum(list(parts["weight"]), axis=0), "first": first})

    def locate(k: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("_piece")
        out = []
        for at, sims, want, after in _located(np.vstack(pieces["weight"]), np.vstack(pieces["first"])):
            row = pieces.iloc[at]
            out.append((*k, int(row["_piece"]), float(row["low"]), bool(row["low"] == row["high"]), sims.astype(np.int32), want, after,
                        row["weight"][sims] == want))
        return pd.DataFrame(out, columns=[*keys, "low", "single", "sims", "want", "after", "even"])

    def open_piece(k: tuple, piece: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        sims, want, after = (np.asarray(wanted[c].iloc[0]) for c in ("sims", "want", "after"))
        search, held = _Search(want), None
        for cells, drawn in _blocks(piece.sort_values("_x"), counts, n, block):
            starts = np.flatnonzero(np.append(True, np.diff(cells["_x"].to_numpy()) > 0))
            xs = cells["_x"].to_numpy()[starts]
            weights = np.add.reduceat(cells["_w"].to_numpy()[:, None] * drawn[:, sims], starts, axis=0)
            if held is not None and held[0] == xs[0]:
                weights[0] += held[1]
            elif held is not None:
                xs, weights = np.append(held[0], xs), np.vstack([held[1], weights])
            held = xs[-1], weights[-1]  # its value may go on in the next block
            search.offer(xs[:-1], weights[:-1])
        search.offer(np.array([held[0]]), held[1][None, :])
        return pd.DataFrame({**dict(zip(by, k)), "sim": sims + 1, "value": search.found(after)})

    parts = cells.groupBy(*keys, "_part").applyInPandas(total, vectors)
    pieces = cut(parts.groupBy(*keys).applyInPandas(together, vectors))
    wanted = cut(pieces.groupBy(*by).applyInPandas(
        locate, f"{fields}_piece int, low double, single boolean, sims array<int>, want array<double>, after array<double>, even array<boolean>"))
    # a piece of one value need not be opened
    each = F.explode(F.arrays_zip("sims", "after", "even")).alias("s")
    known = wanted.where("single").select(*by, "low", each).select(
        *by, (F.col("s.sims") + 1).alias("sim"),
        F.when(F.col("s.even") & (F.col("s.after") < float("inf")), (F.col("low") + F.col("s.after")) / 2).otherwise(F.col("low")).alias("value"))
    wide = wanted.where("not single")
    opened = _matching(cells, wide.select(*keys), keys)
    return known.unionByName(opened.groupBy(*keys).cogroup(wide.groupBy(*keys)).applyInPandas(open_piece, f"{fields}sim int, value double"))


def _matching(df: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    match = F.lit(True)
    some = some.withColumnsRenamed({c: f"_r{c}" for c in keys})
    for c in keys:
        match = match & df[c].eqNullSafe(some[f"_r{c}"])
    return df.join(some, match, "left_semi")


def median(df: DataFrame, by: list[str], x: str, w: str, n: int = 1000, counts: Counts | None = None, key: Column | None = None) -> DataFrame:
    """Median and standard deviation of the weighted medians of resampled rows."""
    return medians(df, by, x, w, n, counts, key).groupBy(*by).agg(F.median("value").alias("median"), F.stddev_pop("value").alias("se"))


def signed_ranks(df: DataFrame, by: list[str], x: str, w: str, baseline: float, n: int = 1000, counts: Counts | None = None, key: Column | None = None) -> DataFrame:
    """Signed-rank sums of x - baseline for every replicate, rows drawn in proportion to weight: by, sim, t_plus, n, ties.

    Zeros are drawn and left out. `ties` is the sum of t**3 - t over sets of t equal absolute values. `key` is a column over by and `_v`.
    """
    counts, block = counts or seeded(1), BLOCK
    rows = df.where(F.col(w) > 0)
    total = rows.groupBy(*by).agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_rows"))
    rows = beside(rows, total, by).withColumn("_v", F.col(x).cast("double") - baseline).where((F.col("_v") != 0) & ~F.isnan("_v"))
    cells = _cells(rows.withColumn("_share", F.col("_rows") * F.col(w) / F.col("_w")), by, {"_v": F.col("_v")}, F.col("_share"), key)
    cells = _in_pieces(cells.withColumn("_a", F.abs("_v")), "_a")
    fields = _fields(df, by)
    names = ["n", "pos", "ranks", "ties"]

    def sums(k: tuple, piece: pd.DataFrame) -> pd.DataFrame:
        """Rank sums as if nothing lay below the piece; what does adds its count to each positive row."""
        out = {c: np.zeros(n) for c in names}
        for same in _whole_values(piece.sort_values(["_a", "_v"]), block):
            drawn = counts(same["_key"].to_numpy(np.int64), same["_mean"].to_numpy(float), n)
            starts = np.flatnonzero(np.append(True, np.diff(same["_a"].to_numpy()) > 0))
            positive = (same["_v"].to_numpy() > 0).astype(float)[:, None]
            for sims in (slice(at, at + STRIP) for at in range(0, n, STRIP)):
                both = drawn[:, sims].astype(float)
                pos = both * positive
                if len(starts) < len(both):
                    both, pos = np.add.reduceat(both, starts, axis=0), np.add.reduceat(pos, starts, axis=0)
                upto = np.cumsum(both, axis=0)
                drawn_here, pos_here = upto[-1].copy(), pos.sum(axis=0)
                upto += out["n"][sims]
                # the mean rank of a value is upto - (both - 1)/2
                out["ranks"][sims] += _dot(pos, upto) - (_dot(pos, both) - pos_here) / 2
                out["ties"][sims] += _dot(both * both, both) - drawn_here
                out["n"][sims] += drawn_here
                out["pos"][sims] += pos_here
        return _keyed([*by, "_piece"], k, out)

    def together(k: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("_piece")
        m = {c: np.vstack(pieces[c]) for c in names}
        below = np.cumsum(m["n"], axis=0) - m["n"]
        return pd.DataFrame({**dict(zip(by, k)), "sim": np.arange(1, n + 1), "t_plus": (m["ranks"] + below * m["pos"]).sum(axis=0),
                             "n": m["n"].sum(axis=0).astype(np.int64), "ties": m["ties"].sum(axis=0)})

    vectors = ", ".join(f"{c} array<double>" for c in names)
    pieces = cut(cells.groupBy(*by, "_piece").applyInPandas(sums, f"{fields}_piece int, {vectors}"))
    return pieces.groupBy(*by).applyInPandas(together, f"{fields}sim int, t_plus double, n long, ties double")


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->j", a, b)


def _whole_values(piece: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Blocks of cells that end between two absolute values: a value has at most two cells."""
    at, a = 0, piece["_a"].to_numpy()
    while at < len(piece):
        to = min(at + size, len(piece))
        while to < len(piece) and a[to] == a[to - 1]:
            to += 1
        yield piece.iloc[at:to]
        at = to


def wilcoxon(df: DataFrame, by: list[str], x: str, w: str, baseline: float, side: str, n: int = 1000, counts: Counts | None = None, key: Column | None = None) -> DataFrame:
    """Signed-rank test of x - baseline on resamples drawn in proportion to weight: mean and deviation of p and of the statistic.

    The score is the tie-corrected normal one. Replicates without a row other than zero have no p.
    """
    test = signed_ranks(df, by, x, w, baseline, n, counts, key).where("n > 0")
    m = F.col("n").cast("double")
    whole = m * (m + 1) / 2
    z = F.try_divide(F.col("t_plus") - whole / 2, F.sqrt(whole * (2 * m + 1) / 12 - F.col("ties") / 48))
    z = {"greater": z, "less": -z}.get(side, F.abs(z))
    p = normal_tail(z) * (1 if side in ("greater", "less") else 2)
    s = F.col("t_plus") if side in ("greater", "less") else F.least(F.col("t_plus"), whole - F.col("t_plus"))
    return test.select(*by, p.alias("p"), s.alias("s")).groupBy(*by).agg(
        F.avg("p").alias("p_mean"), F.stddev_pop("p").alias("p_sd"), F.avg("s").alias("stat_mean"), F.stddev_pop("s").alias("stat_sd"))


def correlation_error(df: DataFrame, by: list[str], x: str, y: str, w: str, n: int = 1000, counts: Counts | None = None, key: Column | None = None) -> DataFrame:
    """Standard deviation of the weighted correlations of resampled rows: by, se. Values are taken from their plain means first.

    A replicate is six sums: for a share of the cells one matrix product of counts and terms. `key` is a column over by, `_x`, `_y` and `_w`.
    """
    counts, block = counts or seeded(1), BLOCK
    means = df.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    cells = _cells(df, by, {"_x": F.col(x), "_y": F.col(y), "_w": F.col(w)}, F.lit(1.0), key).where("_x is not null and _y is not null and _w > 0")
    cells = beside(cells, means, by)
    shares = 1 + cells.count() // PIECE
    cells = cells.withColumn("_share", F.pmod(F.xxhash64("_key"), F.lit(shares)))
    fields = _fields(df, by)

    def sums(k: tuple, share: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((n, 6))
        for part, drawn in _blocks(share, counts, n, block):
            dx, dy, wt = (part["_x"] - part["_mx"]).to_numpy(), (part["_y"] - part["_my"]).to_numpy(), part["_w"].to_numpy()
            out += drawn.T.astype(float) @ np.column_stack([wt, wt * dx, wt * dy, wt * dx * dx, wt * dy * dy, wt * dx * dy])
        return _keyed([*by, "_share"], k, {"sums": out.ravel()})

    def together(k: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        s, sx, sy, sxx, syy, sxy = np.vstack(parts["sums"]).sum(axis=0).reshape(n, 6).T
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (s * sxy - sx * sy) / np.sqrt((s * sxx - sx * sx) * (s * syy - sy * sy))
        r = r[np.isfinite(r)]
        return _keyed(by, k, {"se": float(r.std(ddof=1)) if len(r) > 1 else None})

    parts = cells.groupBy(*by, "_share").applyInPandas(sums, f"{fields}_share long, sums array<double>")
    return parts.groupBy(*by).applyInPandas(together, f"{fields}se double")
