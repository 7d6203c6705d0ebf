"""Replicates of a null model as vectors: a visit keeps the places drawn for it in one array and is shuffled once, not once a replicate.

Places are numbered in blocks, so that a drawn place is one number and its value one entry of a block's array. A row finds its values
by a join on (cell, block), whatever the number of places; it is listed once for each block that its draws fall into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from copresence.functions import draws
from copresence.functions.time_bins import explode_bins
from copresence.operators.batches import starts as starts_of, whole_keys
from copresence.operators.experienced import CELL
from copresence.session import cut, stored

#: Places of a block, as a power of two.
BITS = 10
#: Rows of one person and half hour that are held as they are; beyond, they are counted by value.
HELD = 50_000


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def slots(places: pa.Array, at: pa.Array) -> pa.Array:
    """Per row the 0-based entry of `places`, a list of counts, that holds each of the 1-based positions `at`."""
    first, wanted = _offsets(places), _offsets(at)
    upto = np.concatenate([[0], np.cumsum(places.flatten().to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = np.repeat(np.arange(len(at)), np.diff(wanted))
    found = np.searchsorted(upto[1:], at.flatten().to_numpy(zero_copy_only=False) + upto[first[row]]) - first[row]
    return _lists(wanted, pa.array(found.astype(np.int32)))


def draw_vector(stops: DataFrame, pool: DataFrame, key: list[str], unit: str, ids: list[str], n: int, pick, give: str | None = None) -> DataFrame:
    """`nullmodel.draw` with the n draws of a stop as one array `nos`, null where no pool exists.

    Pools are read in the order of their units; `give` names the column of the pool that is given out, else the unit.
    """
    rows = pool.groupBy(*key).agg(F.sum("places").alias("_size"), F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), "places", F.col(give or unit).alias("v")))).alias("_pool"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda s: draws.position(pick([*[F.col(c) for c in ids], s]), F.col("_size")))
    out = stops.join(rows, key, "left").withColumn("_slot", slots("_pool.places", F.when(F.col("_size").isNotNull(), at)))
    given = F.transform("_slot", lambda i: F.get("_pool.v", i))
    return out.withColumn("nos", F.when(F.col("_size").isNotNull(), given)).drop("_size", "_pool", "_slot")


def each_draw(drawn: DataFrame, unit: str, n: int) -> DataFrame:
    """`nullmodel.draw` from its vectors: a row for each stop and replicate, made where the stop is."""
    nos = F.coalesce("nos", F.array_repeat(F.lit(None).cast(drawn.schema["nos"].dataType.elementType), n))
    return drawn.select("*", F.posexplode(nos).alias("_at", f"{unit}_s")).withColumn("sim", F.col("_at") + 1).drop("nos", "_at")


def draw_counts(drawn: DataFrame, ids: list[str], unit: str) -> DataFrame:
    """`nullmodel.draw_counts` from vectors: the draws of a stop are counted before they are shuffled."""
    each = drawn.select(*ids, F.explode("nos").alias(f"{unit}_s")).where(F.col(f"{unit}_s").isNotNull())
    return each.groupBy(*ids, f"{unit}_s").agg(F.count(F.lit(1)).alias("n"))


def numbered(units: DataFrame, unit: str) -> DataFrame:
    """The distinct units with a number `no` each; the numbers of a block of units share all but their last bits."""
    units = units.select(unit).where(F.col(unit).isNotNull()).distinct()
    parts = 1 + units.count() // 100_000
    return cut(units.coalesce(parts).withColumn("no", F.monotonically_increasing_id()))


def _block(no: Column) -> Column:
    return F.shiftright(no, BITS)


def _slot(no: Column) -> Column:
    return no.bitwiseAND((1 << BITS) - 1)


def in_blocks(df: DataFrame, nos: str = "nos") -> DataFrame:
    """A row for each block that its numbers fall into: `block`; rows without a number drop out."""
    return df.withColumn("block", F.explode(F.array_distinct(F.transform(F.filter(nos, lambda i: i.isNotNull()), _block))))


def looked_up(nos: Column, block: Column, values: Column) -> Column:
    """The values of numbers of the block; null for other numbers."""
    return F.transform(nos, lambda i: F.when(_block(i) == block, F.get(values, _slot(i).cast("int"))))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def spread(slot: pa.Array, value: pa.Array) -> pa.Array:
    """Values as an array by slot, null where a slot has none."""
    ends, at = _offsets(slot), slot.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([at[a:b].max() + 1 if b > a else 0 for a, b in zip(ends, ends[1:])], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    to = np.repeat(starts[:-1], np.diff(ends)) + at
    out, hole = np.full(starts[-1], np.nan), np.ones(starts[-1], bool)
    out[to], hole[to] = value.flatten().to_numpy(zero_copy_only=False), False
    return _lists(starts, pa.array(out, mask=hole))


def cells(metrics: DataFrame, numbers: DataFrame, unit: str, value: str, cell: list[str]) -> DataFrame:
    """The values of a block's units in one row per cell: `values`; a unit's null value is NaN there, a missing one null."""
    rows = metrics.join(numbers, unit).groupBy(*cell, _block(F.col("no")).alias("block")).agg(
        F.collect_list(F.struct(_slot(F.col("no")).alias("s"), F.coalesce(F.col(value), F.lit(float("nan"))).alias("v"))).alias("_v"))
    return stored(rows.select(*cell, "block", spread("_v.s", "_v.v").alias("values")))


def moved(stops: DataFrame, kept: DataFrame, n: int, more: list[str]) -> DataFrame:
    """All stops with n numbers each: drawn ones (`nos`), or n times their own (`no`) where nothing was drawn."""
    own = F.array_repeat("no", n)
    return stops.select(*more, F.coalesce("nos", own).alias("nos")).unionByName(kept.select(*more, own.alias("nos")))


def _middle(block: np.ndarray) -> np.ndarray:
    """Medians along the second axis of (groups, rows, replicates), without NaN."""
    held = (~np.isnan(block)).sum(axis=1)
    block = np.sort(block, axis=1)
    pick = lambda at: np.take_along_axis(block, at[:, None, :], axis=1)[:, 0, :]
    return (pick(np.maximum(held - 1, 0) // 2) + pick(np.minimum(held // 2, block.shape[1] - 1))) / 2


class _Counted:
    """Rows of one key too many to hold: the counts of each replicate's distinct values."""

    def __init__(self, n: int):
        self.values, self.counts, self.found = [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n, np.zeros(n, bool)

    def add(self, rows: np.ndarray, found: np.ndarray) -> None:
        self.found |= found.any(axis=0)
        for s in range(rows.shape[1]):
            seen, count = np.unique(rows[~np.isnan(rows[:, s]), s], return_counts=True)
            both, where = np.unique(np.concatenate([self.values[s], seen]), return_inverse=True)
            self.values[s], self.counts[s] = both, np.bincount(where, np.concatenate([self.counts[s], count]), len(both)).astype(np.int64)

    def medians(self) -> np.ndarray:
        out = np.full(len(self.values), np.nan)
        for s, (values, counts) in enumerate(zip(self.values, self.counts)):
            if len(values):
                upto, all_ = np.cumsum(counts), counts.sum()
                out[s] = (values[np.searchsorted(upto, (all_ - 1) // 2 + 1)] + values[np.searchsorted(upto, all_ // 2 + 1)]) / 2
        return out


def medians(rows: DataFrame, keys: list[str], n: int, values: str = "values") -> DataFrame:
    """Median of each of the n replicates over the rows of a key, in an array: null where no row has a value, NaN where all are NaN.

    Rows are dealt by key and read in order; a key's rows are held up to a bound and counted by value beyond it.
    """
    rows = rows.select(*keys, values)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != values], T.StructField(values, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, big = None, None  # the last key's rows, whose end is not seen yet

        def packed(heads: list[pa.Array], mid: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
            lists = _lists(np.arange(len(mid) + 1) * n, pa.array(mid.ravel(), mask=~found.ravel()))
            return pa.RecordBatch.from_arrays([*heads, lists], names=[*keys, values])

        def closed(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            """One row for each group of the batch; the first one may go on from counted rows."""
            nonlocal big
            flat = batch.column(len(keys)).flatten()
            found = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n)
            matrix = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
            sizes = np.diff(np.append(starts, len(matrix)))
            mid = np.empty((len(starts), n))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                mid[at] = _middle(matrix[starts[at][:, None] + np.arange(size)])
            hit = np.logical_or.reduceat(found, starts, axis=0)
            if big is not None:
                big.add(matrix[:sizes[0]], found[:sizes[0]])
                mid[0], hit[0], big = big.medians(), big.found, None
            return packed([batch.column(i).take(pa.array(starts)) for i in range(len(keys))], mid, hit)

        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            starts = starts_of(batch, len(keys))
            if starts[-1]:
                yield closed(batch.slice(0, starts[-1]), starts[:-1])
            rest = batch.slice(starts[-1])
            if rest.num_rows > HELD:
                big = big or _Counted(n)
                flat = rest.column(len(keys)).flatten()
                held = flat.slice(0, len(flat) - n)
                big.add(held.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n), held.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n))
                rest = rest.slice(rest.num_rows - 1)
        if rest is not None:
            yield closed(rest, np.zeros(1, np.int64))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def met_vectors(visits: DataFrame, values: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Median a person meets per half hour in each replicate, in one array `ice_birth`; visits carry `nos` and their half hours as a span.

    `values` are the cells of the places' values. Replicates without a visited place that has a value are null, NaN stands for a null value.
    """
    halves = explode_bins(in_blocks(visits.select("uid", *CELL[:2], *(by or []), "time_span", "nos")))
    met = halves.join(values, [*CELL, "block"]).withColumn("ice_birth", looked_up(F.col("nos"), F.col("block"), F.col("values")))
    return medians(met, ["uid", *CELL, *(by or [])], n, "ice_birth")


def _filled(x: Column) -> Column:
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))


def vector_mean(df: DataFrame) -> DataFrame:
    """`experienced.sim_mean` of vectors: average over all replicates, then over the half hours of a person."""
    held = _filled(F.col("ice_birth"))
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / F.size(held))
    per_bin = df.where(F.exists("ice_birth", lambda v: v.isNotNull())).select("uid", *CELL[:2], mean.alias("ice_birth"))
    return per_bin.groupBy("uid", *CELL[:2]).agg(F.avg("ice_birth").alias("ice_birth"))


def per_replicate(df: DataFrame) -> DataFrame:
    """A row per replicate: `sim` from 1 and `ice_birth`."""
    rows = df.select("*", F.posexplode("ice_birth").alias("_i", "_v")).where("_v is not null").drop("ice_birth")
    return rows.select(*[c for c in rows.columns if c not in ("_i", "_v")], (F.col("_i") + 1).alias("sim"), F.nanvl("_v", F.lit(None).cast("double")).alias("ice_birth"))


def series_per_replicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """`per_replicate` with the values of a key in one array: a row per key and replicate, made where the key's vectors lie.

    Vectors are dealt by key and read in order; a key has a vector for each of its half hours, and those of the last key are held only.
    """
    rows = df.select(*keys, "ice_birth")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("sim", T.IntegerType()), T.StructField("ice_birth", T.ArrayType(T.DoubleType()))])

    def apart(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        vectors = batch.column(len(keys))
        length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        n = int(length.max(initial=0))
        key = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
        flat = vectors.flatten()
        known, value = flat.is_valid().to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False).astype(float)
        place = np.repeat(key * n, length) + np.arange(len(value)) - np.repeat(np.cumsum(length) - length, length)  # number of its key and replicate
        place, value = place[known], value[known]
        value = value[np.argsort(place, kind="stable")]
        size = np.bincount(place, minlength=len(starts) * n)
        held = np.flatnonzero(size)
        lists = _lists(np.concatenate([[0], np.cumsum(size[held])]), pa.array(value, mask=np.isnan(value)))
        at, sim = np.divmod(held, max(n, 1))
        heads = [batch.column(i).take(pa.array(starts[at])) for i in range(len(keys))]
        return pa.RecordBatch.from_arrays([*heads, pa.array((sim + 1).astype(np.int32)), lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_keys(batches, len(keys)):
            yield apart(batch, starts)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


@F.arrow_udf(T.DoubleType())
def list_mean(lists: pa.Array) -> pa.Array:
    """Mean of the values of each list; null where there is none."""
    value = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    row, known = np.repeat(np.arange(len(lists)), np.diff(_offsets(lists))), ~np.isnan(value)
    n = np.bincount(row[known], minlength=len(lists))
    return pa.array(np.bincount(row[known], value[known], len(lists)) / np.maximum(n, 1), mask=n == 0)


def mix_cells(visits: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """`place.place_mix` per half hour, replicate and place: (time_seq, sim, no, f, d, n); a person counts once in each.

    Visits are dealt by person and half hour with all replicates in one row and read in order, so that a person's places of a half hour stand
    together; a task sums what it read, and of the last person it holds the distinct places only.
    """
    group = F.when(F.col("grp_r") == "F", 0).when(F.col("grp_r") == "D", 1).when(F.col("grp_r") == "N", 2).otherwise(3)
    halves = explode_bins(visits.select("uid", "time_span", "nos").join(groups.select("uid", group.alias("g"), "wt_p"), "uid"))
    dealt = halves.select("time_seq", "uid", "g", "wt_p", "nos").repartition("uid", "time_seq").sortWithinPartitions("time_seq", "uid")
    sums = dealt.mapInArrow(lambda batches: _mixes(batches, n), "time_seq int, sim int, no long, f double, d double, n double")
    return stored(sums.groupBy("time_seq", "sim", "no").agg(*[F.sum(c).alias(c) for c in ("f", "d", "n")]))


def _mixes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    last = None  # time_seq, uid, g and wt_p of the last person's half hour, and its distinct replicates and places

    def summed(time: np.ndarray, group: np.ndarray, w: np.ndarray, sim: np.ndarray, no: np.ndarray) -> pa.RecordBatch:
        units, code = np.unique(no, return_inverse=True)
        cell, where = np.unique((time.astype(np.int64) * n + sim) * len(units) + code, return_inverse=True)
        parts = [np.bincount(where, np.where(group == g, w, 0.0), len(cell)) for g in range(3)]
        at = cell // len(units)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in ((at // n).astype(np.int32), (at % n + 1).astype(np.int32), units[cell % len(units)], *parts)],
                                          names=["time_seq", "sim", "no", "f", "d", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        time, uid, group, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        row = np.concatenate([[0], np.cumsum((time[1:] != time[:-1]) | (uid[1:] != uid[:-1]))])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        no, who, sim = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.repeat(row, n), np.tile(np.arange(n), len(row))
        if last is not None and last[:2] == (time[0], uid[0]):
            no, who, sim = np.concatenate([last[5], no]), np.concatenate([np.zeros(len(last[4]), np.int64), who]), np.concatenate([last[4], sim])
        elif last is not None:
            yield summed(*[np.full(len(last[4]), v) for v in (last[0], *last[2:4])], last[4], last[5])
        units, code = np.unique(no, return_inverse=True)
        once = np.unique((who * n + sim) * len(units) + code)
        no, who, sim = units[once % len(units)], once // len(units) // n, once // len(units) % n
        at, open_ = first[who], who == row[-1]
        if not open_.all():
            done = at[~open_]
            yield summed(time[done], group[done], w[done], sim[~open_], no[~open_])
        last = (time[-1], uid[-1], group[-1], w[-1], sim[open_], no[open_])
    if last is not None:
        yield summed(*[np.full(len(last[4]), v) for v in (last[0], *last[2:4])], last[4], last[5])


def _apart(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "nos"], F.posexplode("nos").alias("_s", "no")).withColumn("sim", F.col("_s") + 1).drop("_s")


def contacts(visits: DataFrame, mix: DataFrame) -> DataFrame:
    """`experienced.person_contact` per replicate, by weight: sums of the mixes that a person meets times the strength of its links.

    A link's strength is the sum of its visits' weights, so every visit adds its own share and links are not built. Visits are dealt by
    person and day type with all replicates in one row, and summed where they are taken apart.
    """
    dealt = visits.select("uid", *CELL[:2], "time_span", "wt_total", "nos").repartition("uid", *CELL[:2])
    met = _apart(explode_bins(dealt.drop(*CELL[:2]))).join(mix, ["time_seq", "sim", "no"])
    return met.groupBy("uid", "sim").agg(*[F.sum(F.col(g) * F.col("wt_total")).alias(g) for g in ("f", "d", "n")])
